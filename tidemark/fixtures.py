"""Research tables derived from the driver's parquet tables.

The driver tables hold no market data, so bars, facts, claims, predictions and so on
are deterministic views over them. Sums run over integers (cents, units) so that values
do not depend on the order of addition. ``oracles.py`` states the same views for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ranks
from .functions.scalars import bar_available_at, decision_at, filing_available_at
from .operators import ranking

# Fixed values of the fixtures.
SPLIT_DATE = "1998-06-08"
LISTING_BREAK = "1998-07-01"
FIRST_DAY = "1995-01-01"

# The six baseline features and their direction.
BASELINE_FEATURES = {
    "momentum_12_1": 1,
    "relative_strength_6m": 1,
    "earnings_yield_ttm": 1,
    "return_on_assets_ttm": 1,
    "trailing_volatility_60d": -1,
    "median_dollar_volume_20d": 1,
}

# A fixture linear model: (feature, coefficient, mean, scale); one input is switched off.
MODEL_INPUTS = [
    ("momentum_12_1", 0.020, 0.5, 0.30),
    ("relative_strength_6m", -0.015, 0.5, 0.25),
    ("earnings_yield_ttm", 0.010, 0.5, 0.30),
    ("return_on_assets_ttm", 0.005, 0.5, 0.20),
    ("trailing_volatility_60d", 0.0, 0.5, 0.30),
    ("median_dollar_volume_20d", 0.008, 0.5, 0.30),
]
TARGET_MEAN = 0.001
MODEL_VERSION = "linear_fixture_v1"


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


class Research:
    """Lazy research tables for one data folder. Nothing is cached or collected."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- bars ---------------------------------------------------------------
    @cached_property
    def trades(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("security_id"),
            "l_partkey",
            F.to_date("l_shipdate").alias("ship_day"),
            F.to_date(F.date_trunc("week", "l_shipdate")).alias("session_date"),
            F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            cents("l_extendedprice").alias("cents"),
            F.col("l_quantity").cast("long").alias("quantity"),
            cents("l_discount").alias("discount"),
            cents("l_tax").alias("tax"),
            (F.col("l_returnflag") == "R").cast("long").alias("returned"),
            F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Split-adjusted weekly bars per supplier; partial aggregation absorbs hot suppliers."""
        return self.bars_of(self.trades)

    @staticmethod
    def bars_of(trades: DataFrame) -> DataFrame:
        return (
            trades.groupBy("security_id", "session_date")
            .agg(
                F.min_by("price", "seq").alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", "seq").alias("close"),
                F.sum("quantity").alias("volume"),
            )
            .withColumn("available_at", bar_available_at(F.col("session_date")))
        )

    @cached_property
    def unadjusted_bars(self) -> DataFrame:
        return self.unadjusted(self.bars)

    @staticmethod
    def unadjusted(bars: DataFrame) -> DataFrame:
        factor = F.when(F.col("session_date") < F.lit(SPLIT_DATE).cast("date"), 2.0).otherwise(1.0)
        return bars.select(
            "security_id", "session_date",
            (F.col("close") * factor).alias("close"),
            (F.col("volume") / factor).alias("volume"),
            "available_at",
        )

    @cached_property
    def benchmark_bars(self) -> DataFrame:
        """All suppliers pooled: weekly volume-weighted price. Also the trading calendar."""
        early = F.dayofweek("ship_day").isin(2, 3, 4)
        vwap = lambda keep: (
            F.sum(F.when(keep, F.col("cents"))) / F.lit(100.0) / F.sum(F.when(keep, F.col("quantity")))
        )
        return (
            self.trades.groupBy("session_date")
            .agg(vwap(F.lit(True)).alias("close"), vwap(early).alias("_early"))
            .select(
                "session_date", F.coalesce("_early", "close").alias("open"), "close",
                bar_available_at(F.col("session_date")).alias("available_at"),
            )
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """Calendar with a dense index; one row per session, so the global window is bounded."""
        ordered = Window.partitionBy(F.lit(1)).orderBy("session_date")
        return (
            self.trades.select("session_date").distinct()
            .select(
                "session_date",
                F.row_number().over(ordered).alias("idx"),
                F.lead("session_date").over(ordered).alias("next_session"),
            )
        )

    @cached_property
    def formations(self) -> DataFrame:
        """Last session of each month, with the 20:00 local decision time."""
        return (
            self.trades.select("session_date").distinct()
            .groupBy(F.to_date(F.date_trunc("month", "session_date")).alias("_month"))
            .agg(F.max("session_date").alias("formation_date"))
            .select("formation_date", decision_at(F.col("formation_date")).alias("decision_at"))
        )

    # ---- dense brand bars for labels ---------------------------------------
    @cached_property
    def dense_bars(self) -> DataFrame:
        brands = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.substring("p_brand", 7, 10).cast("long").alias("security_id"),
        )
        weekly = (
            self.trades.drop("security_id").join(brands, "l_partkey")
            .groupBy("security_id", "session_date")
            .agg((F.sum("cents") / F.lit(100.0) / F.sum("quantity")).alias("vwap"), F.sum("quantity").alias("volume"))
        )
        return self._running(weekly, ["security_id"])

    @cached_property
    def dense_benchmark(self) -> DataFrame:
        weekly = self.trades.groupBy("session_date").agg(
            (F.sum("cents") / F.lit(100.0) / F.sum("quantity")).alias("vwap"), F.sum("quantity").alias("volume")
        )
        return self._running(weekly, [F.lit(1)]).drop("unadjusted_open").withColumnRenamed("adjusted_open", "open")

    @staticmethod
    def _running(weekly: DataFrame, keys: list) -> DataFrame:
        running = Window.partitionBy(*keys).orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
        factor = F.when(F.col("session_date") < F.lit(SPLIT_DATE).cast("date"), 2.0).otherwise(1.0)
        return (
            weekly.withColumn("adjusted_open", F.avg("vwap").over(running))
            .withColumn("unadjusted_open", F.col("adjusted_open") * factor)
            .withColumn("available_at", bar_available_at(F.col("session_date")))
            .drop("vwap")
        )

    @cached_property
    def actions(self) -> DataFrame:
        """A dividend each 26th session, one 2-for-1 split, a few spin-offs; per brand."""
        rows = self.dense_bars.join(self.sessions.drop("next_session"), "session_date")
        brand, session, idx = F.col("security_id"), F.col("session_date"), F.col("idx")
        split = session == F.lit(SPLIT_DATE).cast("date")
        kind = (
            F.when(split, F.lit("forward_split"))
            .when((idx == 300) & (brand % 17 == 0), F.lit("spin_off"))
            .when(idx % 26 == 0, F.lit("cash_dividend"))
        )
        return (
            rows.withColumn("action_type", kind).where(F.col("action_type").isNotNull())
            .select(
                "security_id",
                F.concat_ws("-", brand.cast("string"), F.date_format(session, "yyyyMMdd")).alias("action_id"),
                "action_type",
                session.alias("effective_date"),
                F.date_add(session, 1).alias("process_date"),
                F.when(F.col("action_type") == "cash_dividend", F.lit(12.5)).alias("cash_amount"),
                F.when(F.col("action_type") == "forward_split", F.lit(2.0)).alias("ratio_numerator"),
                F.when(F.col("action_type") == "forward_split", F.lit(1.0)).alias("ratio_denominator"),
                F.lit("USD").alias("currency"),
                bar_available_at(session).alias("available_at"),
            )
        )

    # ---- dated reference data ----------------------------------------------
    @cached_property
    def securities(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("security_id"), F.col("s_name").alias("issuer_name"),
            F.col("s_nationkey").alias("nation_key"),
        )

    @cached_property
    def sector_claims(self) -> DataFrame:
        """A first claim per supplier and, for every fourth, a revision in 1998."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").cast("long").alias("region"))
        base = self.securities.join(nation, "nation_key")
        first = base.select(
            "security_id", F.concat(F.lit("sector_"), F.col("region").cast("string")).alias("sector_code"),
            F.lit(FIRST_DAY).cast("date").alias("as_of_date"),
        )
        revised = base.where(F.col("security_id") % 4 == 0).select(
            "security_id", F.concat(F.lit("sector_"), ((F.col("region") + 1) % 5).cast("string")).alias("sector_code"),
            F.lit("1998-01-01").cast("date").alias("as_of_date"),
        )
        return first.unionByName(revised).withColumn(
            "available_at", F.col("as_of_date").cast("timestamp") + F.expr("INTERVAL 1 DAY")
        )

    @cached_property
    def sectors(self) -> DataFrame:
        """The static sector per supplier."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region"))
        return self.securities.join(nation, "nation_key").select(
            "security_id", F.concat(F.lit("sector_"), F.col("region").cast("string")).alias("sector_code")
        )

    @cached_property
    def listings(self) -> DataFrame:
        """Two validity rows per supplier, the second one open."""
        ticker = lambda prefix: F.concat(F.lit(prefix), F.col("security_id").cast("string"))
        day = lambda text: F.lit(text).cast("date")
        old = self.securities.select(
            "security_id", ticker("OLD").alias("ticker"), F.lit("XNYS").alias("mic"),
            day(FIRST_DAY).alias("valid_from"), day(LISTING_BREAK).alias("valid_to"),
        )
        new = self.securities.select(
            "security_id", ticker("TKR").alias("ticker"), F.lit("XNYS").alias("mic"),
            day(LISTING_BREAK).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
        )
        return old.unionByName(new)

    # ---- filings and facts --------------------------------------------------
    @cached_property
    def quarters(self) -> DataFrame:
        priority = F.substring("o_orderpriority", 1, 1).cast("int")
        return (
            self.table("orders")
            .select(
                F.floor(F.col("o_custkey") / 15).cast("long").alias("security_id"),
                F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("qtr"),
                cents("o_totalprice").alias("cents"), priority.alias("priority"),
            )
            .groupBy("security_id", "fy", "qtr")
            .agg(
                F.sum("cents").alias("income"),
                F.sum(F.when(F.col("priority") <= 3, F.col("cents")).otherwise(0)).alias("cash"),
                F.count(F.lit(1)).alias("orders"),
            )
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Cumulative flow facts and instant facts per filing, with annual amendments."""
        in_year = Window.partitionBy("security_id", "fy").orderBy("qtr").rowsBetween(Window.unboundedPreceding, 0)
        ever = Window.partitionBy("security_id").orderBy("fy", "qtr").rowsBetween(Window.unboundedPreceding, 0)
        q = (
            self.quarters
            .withColumn("income_ytd", F.sum("income").over(in_year))
            .withColumn("cash_ytd", F.sum("cash").over(in_year))
            .withColumn("income_ever", F.sum("income").over(ever))
            .withColumn("orders_ever", F.sum("orders").over(ever))
            .withColumn("period_end", F.last_day(F.make_date("fy", F.col("qtr") * 3, F.lit(1))))
        )
        year_start = F.make_date(F.col("fy"), F.lit(1), F.lit(1))
        none = F.lit(None).cast("date")
        sec = F.col("security_id")
        row = lambda taxonomy, concept, unit, start, value: F.struct(
            F.lit(taxonomy).alias("taxonomy"), concept.alias("concept"), F.lit(unit).alias("unit"),
            start.alias("period_start"), value.cast("double").alias("value"),
        )
        income_concept = F.when(sec % 7 == 3, F.lit("ProfitLoss")).otherwise(F.lit("NetIncomeLoss"))
        rows = F.array(
            row("us-gaap", income_concept, "USD", year_start, F.col("income_ytd") / 100.0),
            row("us-gaap", F.lit("NetCashProvidedByUsedInOperatingActivities"), "USD", year_start, F.col("cash_ytd") / 100.0),
            row("us-gaap", F.lit("Assets"), "USD", none, F.col("income_ever") / 100.0 + 1000000),
            row("us-gaap", F.lit("StockholdersEquity"), "USD", none, F.col("income_ever") / 200.0),
            row("dei", F.lit("EntityCommonStockSharesOutstanding"), "shares", none, F.col("orders_ever") * 1000.0 + 10000),
        )
        accession = F.concat_ws("-", sec.cast("string"), F.col("fy").cast("string"), F.col("qtr").cast("string"))
        original = q.select(
            "security_id", "fy", "qtr", "period_end", accession.alias("accession"),
            F.when(F.col("qtr") == 4, F.lit("10-K")).otherwise(F.lit("10-Q")).alias("form"),
            F.lit(False).alias("is_amendment"),
            (F.date_add("period_end", 30 + (sec % 20).cast("int")).cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("accepted_at"),
            F.explode(rows).alias("f"),
        ).select("security_id", "fy", "qtr", "period_end", "accession", "form", "is_amendment", "accepted_at", "f.*")
        amended = (
            original.where((sec % 10 == 0) & (F.col("qtr") == 4) & (F.col("concept") == "NetIncomeLoss"))
            .withColumn("accession", F.concat("accession", F.lit("A")))
            .withColumn("form", F.lit("10-K/A")).withColumn("is_amendment", F.lit(True))
            .withColumn("accepted_at", F.col("accepted_at") + F.expr("INTERVAL 60 DAYS"))
            .withColumn("value", F.col("value") + 1000)
        )
        return original.unionByName(amended).select(
            "security_id", "accession", "form", "is_amendment", "accepted_at",
            filing_available_at(F.col("accepted_at")).alias("available_at"),
            "taxonomy", "concept", "unit", "period_start", "period_end", F.col("fy").alias("fiscal_year"),
            F.when(F.col("qtr") == 4, F.lit("FY")).otherwise(F.concat(F.lit("Q"), F.col("qtr").cast("string"))).alias("fiscal_period"),
            "value",
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Append-only fact observations from events; every tenth arrives twice."""
        base = self.table("events").select(
            "event_id", F.col("user_id").alias("security_id"), F.col("event_type").alias("concept"), "value",
            F.col("ts").cast("timestamp").alias("observed_at"),
            (F.col("ts").cast("timestamp") - F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))).alias("accepted_at"),
            F.to_date(F.date_trunc("week", "ts")).alias("period_end"),
        )
        return base.unionByName(base.where(F.col("event_id") % 10 == 0)).withColumn(
            "lineage_key", F.lpad(F.col("event_id").cast("string"), 20, "0")
        )

    @cached_property
    def observation_decisions(self) -> DataFrame:
        """One decision at noon of each day that has an observation."""
        return self.table("events").select(F.to_date("ts").alias("formation_date")).distinct().withColumn(
            "decision_at", F.col("formation_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
        )

    # ---- feature outcomes, scores, predictions ------------------------------
    @cached_property
    def monthly(self) -> DataFrame:
        return self.trades.groupBy("security_id", F.col("month").alias("formation_date")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("discount").alias("d"), F.sum("tax").alias("t"),
            F.sum("quantity").alias("q"), F.sum("returned").alias("r"), F.sum("cents").alias("c"),
            (F.max("quantity") - F.min("quantity")).alias("spread"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Long value-or-reason rows: six baseline features per supplier and month."""
        n = F.col("n")
        short = F.when(n < 3, F.lit("insufficient_history"))
        hole = F.when((F.col("security_id") + F.month("formation_date")) % 11 == 0, F.lit("missing annual income fact"))
        none = F.lit(None).cast("string")
        cell = lambda key, value, reason: F.struct(
            F.lit(key).alias("feature_key"),
            F.when(reason.isNull(), value).alias("value"), reason.alias("unavailable_reason"),
        )
        cells = F.array(
            cell("momentum_12_1", F.col("d") / n, none),
            cell("relative_strength_6m", F.col("t") / n, none),
            cell("earnings_yield_ttm", F.col("q") / n, hole),
            cell("return_on_assets_ttm", F.col("r") / n, none),
            cell("trailing_volatility_60d", F.col("spread").cast("double"), short),
            cell("median_dollar_volume_20d", F.col("c") / n / 100.0, none),
        )
        return self.monthly.select("security_id", "formation_date", F.explode(cells).alias("x")).select(
            "security_id", "formation_date", "x.*"
        )

    @cached_property
    def model_inputs(self) -> DataFrame:
        """The coefficient table: one row per model input, fixed size."""
        rows = ", ".join(f"('{k}', {c}D, {m}D, {s}D, {i})" for i, (k, c, m, s) in enumerate(MODEL_INPUTS))
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(feature_key, coefficient, mean, scale, ordinal)")

    @cached_property
    def registry(self) -> DataFrame:
        rows = ", ".join(f"('{k}', 'v1', {d})" for k, d in BASELINE_FEATURES.items())
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(feature_key, feature_version, direction)")

    @cached_property
    def sector_ranks(self) -> DataFrame:
        return ranking.sector_percentiles(self.outcomes, self.sectors, self.registry)

    @cached_property
    def scores(self) -> DataFrame:
        """Published snapshots per supplier and month: eligible first, ranked by raw prediction."""
        raw = self.monthly.select(
            "security_id", F.col("formation_date").alias("score_date"),
            (F.col("n") >= 3).alias("eligible"),
            ((F.col("d") * 3 + F.col("t")) / F.col("n")).alias("raw_prediction"),
        )
        placed = ranks.with_position(
            raw.where("eligible"), ["score_date"], "raw_prediction", "security_id",
            descending=True, position="score_rank", size="ranked",
        )
        missed = raw.where("NOT eligible").withColumn("score_rank", F.lit(None).cast("long")).withColumn("ranked", F.lit(None).cast("long"))
        size = F.when(F.col("ranked") > 1, F.col("ranked") - 1)
        return (
            placed.unionByName(missed)
            .withColumn("score", F.coalesce(F.lit(100.0) * (F.col("ranked") - F.col("score_rank")) / size, F.lit(0.0)))
            .withColumn("exclusion_reason", F.when(~F.col("eligible"), F.lit("insufficient price sessions")))
            .withColumn("model_version", F.lit(MODEL_VERSION))
            .drop("ranked")
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Two models' predictions and the realised relative return per supplier and week."""
        weekly = self.trades.groupBy("security_id", "session_date").agg(
            F.count(F.lit(1)).alias("n"), F.sum("discount").alias("d"), F.sum("tax").alias("t"), F.sum("quantity").alias("q"),
        )
        n = F.col("n")
        models = F.array(
            F.struct(F.lit("reference").alias("model_key"), (F.col("d") / n / 100.0).alias("prediction")),
            F.struct(F.lit("candidate").alias("model_key"), ((F.col("d") * 2 + F.col("t")) / n / 300.0).alias("prediction")),
        )
        return weekly.select(
            "security_id", F.col("session_date").alias("formation_date"),
            F.to_date(F.date_trunc("month", "session_date")).alias("month"),
            F.year("session_date").alias("outer_fold"),
            ((F.col("t") * 2 + F.col("q") - n * 33) / n / 100.0).alias("actual"),
            F.explode(models).alias("m"),
        ).select("m.*", "outer_fold", "formation_date", "month", "security_id", "actual")

    @cached_property
    def examples(self) -> DataFrame:
        """Training examples per supplier and month: three bounded features, a target, an outcome date."""
        n = F.col("n")
        return self.monthly.select(
            "security_id", "formation_date", F.add_months("formation_date", 1).alias("outcome_date"),
            (F.col("d") / n / 10.0).alias("f1"), (F.col("q") / n / 50.0).alias("f2"), (F.col("r") / n).alias("f3"),
            ((F.col("t") * 2 + F.col("q") - n * 33) / n / 100.0).alias("target"),
        )
