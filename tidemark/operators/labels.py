"""Forward labels and wealth accounting.

Prices meet the small window x session table by an equi join; every fact about a window is
then a partial aggregate. A price jump is a property of two adjacent bars, so it is found
once per bar rather than once per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import window_sessions
from ..functions.ranks import cumulative_below, order_bucket, value_counts
from ..functions.scalars import canonical_json_hash, first_reason
from .joins import actions_in_windows

# Action types and limits.
SPLITS = ("forward_split", "reverse_split", "unit_split")
CASH = ("cash_dividend",)
NEUTRAL = ("name_change",)
COMPLEX = (
    "stock_dividend", "spin_off", "cash_merger", "stock_merger", "stock_and_cash_merger", "redemption",
    "worthless_removal", "rights_distribution", "partial_call", "reorganization",
)
JUMP = 0.15
P95_LIMIT, MAX_LIMIT = 0.0010, 0.0025
KEY = ["formation_date", "security_id"]


def forward_windows(sessions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(score_date, horizon, entry, exit): the first later session and the h-th one, where the calendar has them."""
    index = sessions.select("session_date", "idx")
    exits = F.explode(F.array(*[F.lit(h) for h in horizons]))
    windows = index.withColumnRenamed("session_date", "score_date").withColumn("horizon", exits)
    at = lambda name: index.withColumnsRenamed({"session_date": name, "idx": f"_{name}"})
    return windows.join(at("entry"), F.col("_entry") == F.col("idx") + 1).join(at("exit"), F.col("_exit") == F.col("idx") + F.col("horizon")).select(
        "score_date", "horizon", "entry", "exit")


def forward_returns(snapshots: DataFrame, sessions: DataFrame, bars: DataFrame, benchmark: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Close at the first later session to close at the h-th one, against the benchmark (LBL01).

    ``snapshots`` has security_id and score_date on sessions. Missing marks withhold the label.
    """
    return returns_over(forward_windows(sessions, horizons), snapshots, bars, benchmark)


def returns_over(windows: DataFrame, snapshots: DataFrame, bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Relative returns of the snapshots over ``windows`` (score_date, horizon, entry, exit)."""
    marks = lambda df, keys, side, prefix: df.select(
        *keys, F.col("session_date").alias(side), F.col("close").alias(f"{prefix}_{side}"), F.col("available_at").alias(f"{prefix}_{side}_at"))
    windows = windows.join(marks(benchmark, [], "entry", "b"), "entry", "left").join(marks(benchmark, [], "exit", "b"), "exit", "left")
    rows = snapshots.join(windows, "score_date")
    rows = rows.join(marks(bars, ["security_id"], "entry", "s"), ["security_id", "entry"], "left").join(
        marks(bars, ["security_id"], "exit", "s"), ["security_id", "exit"], "left")
    reason = first_reason(
        (F.col("s_entry").isNull() | F.col("s_exit").isNull(), "security price unavailable"),
        (F.col("b_entry").isNull() | F.col("b_exit").isNull(), "benchmark price unavailable"))
    relative = F.col("s_exit") / F.col("s_entry") - F.col("b_exit") / F.col("b_entry")
    return rows.select(
        "security_id", "score_date", "horizon", F.col("exit").alias("outcome_date"),
        F.when(reason.isNull(), "completed").otherwise("withheld").alias("status"), reason.alias("reason"),
        F.when(reason.isNull(), relative).alias("relative_return"),
        F.when(reason.isNull(), F.greatest("s_entry_at", "s_exit_at", "b_entry_at", "b_exit_at")).alias("cutoff_at"))


def bar_jumps(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Open-to-open move of each bar against the previous own bar, after same-day splits."""
    ratio = splits.where(F.col("action_type").isin(*SPLITS)).groupBy("security_id", F.col("effective_date").alias("session_date")).agg(
        F.product(F.col("ratio_numerator") / F.col("ratio_denominator")).alias("_ratio"))
    own = Window.partitionBy("security_id").orderBy("session_date")
    return bars.join(ratio, ["security_id", "session_date"], "left").select(
        "security_id", "session_date", "price", "available_at",
        (F.col("price") * F.coalesce("_ratio", F.lit(1.0)) / F.lag("price").over(own) - 1).alias("jump"))


def ledger_actions(actions: DataFrame, sessions: DataFrame, windows: DataFrame, horizon: int) -> DataFrame:
    """Quantity, cash and withholding flags of each window's actions.

    Splits come before dividends of the same day, then ids; the running product of ratios
    within a window is the quantity a dividend is paid on.
    """
    kind = F.col("action_type")
    known = kind.isin(*SPLITS, *CASH, *NEUTRAL, *COMPLEX)
    rows = actions_in_windows(actions, sessions, windows, horizon)
    place = F.when(kind.isin(*SPLITS), 0).when(kind.isin(*CASH), 1).otherwise(2)
    ordered = Window.partitionBy(*KEY).orderBy("effective_date", place, "action_id").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.when(kind.isin(*SPLITS), F.col("ratio_numerator") / F.col("ratio_denominator")).otherwise(1.0)
    rows = rows.withColumn("_held", F.product(F.coalesce(ratio, F.lit(1.0))).over(ordered))
    bad_cash = kind.isin(*CASH) & (F.col("cash_amount").isNull() | (F.col("cash_amount") < 0) | (F.col("currency") != "USD"))
    named = lambda rule: F.array_join(F.array_sort(F.collect_set(F.when(rule, kind))), ", ")
    return rows.groupBy(*KEY).agg(
        F.max_by("_held", F.struct("effective_date", place, "action_id")).alias("quantity"),
        F.sum(F.when(kind.isin(*CASH), F.col("_held") * F.col("cash_amount")).otherwise(0.0)).alias("cash"),
        F.count(F.lit(1)).alias("action_count"), F.max("available_at").alias("action_at"),
        named(~known).alias("unknown_types"), named(kind.isin(*COMPLEX)).alias("complex_types"),
        F.max(F.col("effective_date").isNull()).alias("undated"), F.max(kind.isin(*SPLITS) & ratio.isNull()).alias("bad_split"),
        F.max(bad_cash).alias("bad_cash"))


def wealth_returns(bars: DataFrame, actions: DataFrame, sessions: DataFrame, windows: DataFrame, horizon: int = 20) -> DataFrame:
    """One share through splits and cash dividends from entry to outcome, or a reason (LBL02, JN12).

    ``bars`` has security_id, session_date, price, available_at.
    """
    path = window_sessions(sessions, windows, horizon)
    inside = F.col("step") > 0
    marks = bar_jumps(bars, actions).join(path, "session_date").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("marks"), F.first("entry_date").alias("entry_date"), F.first("outcome_date").alias("outcome_date"),
        F.max(F.when(F.col("step") == 0, F.col("price"))).alias("entry_price"),
        F.max(F.when(F.col("step") == horizon, F.col("price"))).alias("exit_price"),
        F.min(F.when(inside & (F.abs("jump") > JUMP), F.col("session_date"))).alias("jump_date"),
        F.max("available_at").alias("mark_at"))
    rows = marks.join(ledger_actions(actions, sessions, windows, horizon), KEY, "left")
    reason = first_reason(
        (F.col("marks") < horizon + 1, "missing_complete_security_price_path"),
        (F.length("unknown_types") > 0, F.concat(F.lit("unknown corporate action type: "), "unknown_types")),
        (F.col("undated"), "corporate action has no effective date"),
        (F.length("complex_types") > 0, F.concat(F.lit("unresolved complex corporate action: "), "complex_types")),
        (F.col("jump_date").isNotNull(), F.concat(F.lit("unexplained structural price discontinuity on "), F.col("jump_date").cast("string"))),
        (F.col("bad_split"), "split action has no complete ratio"), (F.col("bad_cash"), "cash dividend has invalid amount or currency"))
    quantity, cash = F.coalesce("quantity", F.lit(1.0)), F.coalesce("cash", F.lit(0.0))
    done = reason.isNull()
    return rows.select(
        *KEY, "entry_date", "outcome_date", F.when(done, "completed").otherwise("withheld").alias("status"), reason.alias("reason"),
        F.when(done, quantity).alias("quantity"), F.when(done, cash).alias("cash"),
        F.when(done, (quantity * F.col("exit_price") + cash) / F.col("entry_price") - 1).alias("wealth_return"),
        F.when(done, F.greatest("mark_at", "action_at")).alias("cutoff_at"))


def relative_wealth(security: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Security minus benchmark when both completed, else the joined reasons (LBL03)."""
    other = benchmark.select("formation_date", F.col("wealth_return").alias("benchmark_return"), F.col("reason").alias("benchmark_reason"), F.col("cutoff_at").alias("benchmark_cutoff_at"))
    rows = security.join(other, "formation_date")
    reason = F.when(F.col("reason").isNotNull() | F.col("benchmark_reason").isNotNull(), F.concat_ws("; ", "reason", "benchmark_reason"))
    return rows.select(
        *KEY, "entry_date", "outcome_date", "wealth_return", "benchmark_return", reason.alias("reason"),
        (F.col("wealth_return") - F.col("benchmark_return")).alias("relative_return"), "cutoff_at")


def with_label_hash(labels: DataFrame) -> DataFrame:
    """Content hash of a completed label and its lineage (LBL04)."""
    digest = canonical_json_hash(*[F.col(c) for c in ("security_id", "formation_date", "entry_date", "outcome_date", "wealth_return", "benchmark_return", "relative_return")])
    return labels.withColumn("label_sha256", F.when(F.col("reason").isNull(), digest))


def exclusion_category(reason: Column) -> Column:
    """Reason text to category (LBL05)."""
    complex_code = F.regexp_replace(F.regexp_replace(reason, " ", "_"), ":_", ":")
    return (
        F.when(reason.startswith("unexplained structural price discontinuity"), "unexplained_structural_price_discontinuity")
        .when(reason.startswith("corporate action has no effective date"), "undated_corporate_action")
        .when(reason.startswith("unresolved complex corporate action"), complex_code).otherwise(reason))


def execution_periods(formations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Entry and exit sessions between consecutive formations' next sessions (LBL06)."""
    ordered = Window.partitionBy(F.lit(1)).orderBy("formation_date")
    starts = formations.select("formation_date").join(
        sessions.select(F.col("session_date").alias("formation_date"), F.col("next_session").alias("execution_date")), "formation_date")
    return starts.withColumn("exit_date", F.lead("execution_date").over(ordered)).where("exit_date IS NOT NULL")


def basket_returns(selected: DataFrame, periods: DataFrame, opens: DataFrame, size: int) -> DataFrame:
    """Mean exit/entry of exactly ``size`` names minus one; a missing mark withholds the period (LBL06, LBL07)."""
    marks = lambda side: opens.select("security_id", F.col("session_date").alias(side), F.col("open").alias(f"{side}_open"))
    rows = selected.join(periods, "formation_date").join(marks("execution_date"), ["security_id", "execution_date"], "left").join(
        marks("exit_date"), ["security_id", "exit_date"], "left")
    ratio = F.col("exit_date_open") / F.col("execution_date_open")
    grouped = rows.groupBy("formation_date", "execution_date", "exit_date").agg(
        F.count(F.lit(1)).alias("names"), F.count(ratio).alias("marked"), F.avg(ratio).alias("_mean"))
    whole = (F.col("names") == size) & (F.col("marked") == size)
    return grouped.select("formation_date", "execution_date", "exit_date", "names", whole.alias("complete"), F.when(whole, F.col("_mean") - 1).alias("gross_return"))


def nearest_rank(df: DataFrame, value: str, probability: float) -> DataFrame:
    """One-row nearest-rank percentile: the value at index round-half-up((n - 1) x p)."""
    counts = cumulative_below(value_counts(df.withColumn("_g", F.lit(1)), ["_g"], value), ["_g"], [value], order_bucket(F.col(value)), "ties")
    index = F.floor((F.col("total") - 1) * probability + 0.5)
    covers = (F.col("below") <= index) & (index < F.col("below") + F.col("ties"))
    return counts.agg(F.max(F.when(covers, F.col(value))).alias("percentile"))


def reconciliation_report(compared: DataFrame) -> DataFrame:
    """Comparison counts, nearest-rank p95, maximum and pass flag of absolute differences (LBL08)."""
    summary = compared.agg(
        F.count("difference").alias("comparisons"), F.count_if(F.col("status") == "withheld").alias("withheld"), F.max("difference").alias("largest"))
    rows = summary.crossJoin(F.broadcast(nearest_rank(compared, "difference", 0.95)))
    return rows.withColumnRenamed("percentile", "p95").withColumn("passed", (F.col("p95") <= P95_LIMIT) & (F.col("largest") <= MAX_LIMIT))


def mark_to_market(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """(cash + sum of quantity x close) / start - 1 per run; withheld when a close is missing (LBL09)."""
    rows = positions.join(closes, ["security_id", "session_date"], "left")
    grouped = rows.groupBy("run_id", "session_date").agg(
        F.max("ending_cash").alias("_cash"), F.max("starting_nav").alias("_start"), F.sum(F.col("quantity") * F.col("close")).alias("_value"),
        F.count_if(F.col("close").isNull()).alias("missing"))
    return grouped.select("run_id", "session_date", "missing", F.when(F.col("missing") == 0, (F.col("_cash") + F.col("_value")) / F.col("_start") - 1).alias("portfolio_return"))


def checkpoint_outcomes(positions: DataFrame, wealth: DataFrame) -> DataFrame:
    """Portfolio outcome per run and horizon from its positions' ledgers; any withheld one withholds it (LBL10)."""
    rows = positions.join(wealth, ["formation_date", "security_id"], "left")
    reason = F.when(F.col("status").isNull(), "price path unavailable").otherwise(F.col("reason"))
    grouped = rows.groupBy("formation_date").agg(
        F.count(F.lit(1)).alias("positions"), F.max(reason).alias("reason"), F.avg("wealth_return").alias("_mean"))
    return grouped.select("formation_date", "positions", "reason", F.when(F.col("reason").isNull(), F.col("_mean")).alias("portfolio_return"))


def forward_readiness(snapshots: int | DataFrame, outcomes: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Completed, withheld and pending labels per horizon (LBL11)."""
    done = F.col("status") == "completed"
    summary = outcomes.groupBy("horizon").agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "withheld").alias("withheld"),
        F.count_distinct(F.when(done, F.col("score_date"))).alias("completed_dates"), F.max("outcome_date").alias("latest_outcome"))
    totals = snapshots.agg(F.count(F.lit(1)).alias("_total")).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return totals.join(summary, "horizon", "left").select(
        "horizon", zero("completed"), zero("withheld"), zero("completed_dates"), "latest_outcome",
        (F.col("_total") - F.coalesce("completed", F.lit(0)) - F.coalesce("withheld", F.lit(0))).alias("pending"))
