"""Coverage, drift, health and freshness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..functions.scalars import safe_divide
from ..session import cut_lineage
from .evaluation import correlation, top_turnover

# Health thresholds (warning, critical) and limits.
COVERAGE = (0.98, 0.90)
MISSING = (0.02, 0.10)
DRIFT = (0.10, 0.25)
CHURN, RANK_CHANGE = 0.50, 0.15
REFERENCE_DATES, MINIMUM_OBSERVATIONS = 20, 100
FLOOR = 1e-6
CANDIDATE_GATES = {"aggregate": 0.90, "monthly": 0.80, "redundancy": 0.90, "stability": 0.10, "turnover": 0.90}


def feature_coverage(outcomes: DataFrame, keys: Sequence[str] = ("formation_date", "feature_key")) -> DataFrame:
    """Available over universe per feature (MON01)."""
    return outcomes.groupBy(*keys).agg(
        F.count("value").alias("available"), F.count(F.lit(1)).alias("universe"), (F.count("value") / F.count(F.lit(1))).alias("coverage"))


def missing_reasons(outcomes: DataFrame) -> DataFrame:
    """Reason counts per feature (MON01)."""
    return outcomes.where("value IS NULL").groupBy("feature_key", "unavailable_reason").agg(F.count(F.lit(1)).alias("securities"))


def feature_correlations(wide: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Pearson per pair of features over rows holding both; null with a reason when undefined (MON02)."""
    cells = []
    for i, a in enumerate(features):
        for b in features[i + 1:]:
            x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
            cells.append(F.struct(F.lit(a).alias("left_key"), F.lit(b).alias("right_key"), F.count(x).alias("pairs"),
                                  correlation(x, y).alias("correlation")))
    row = wide.groupBy(*keys).agg(F.array(*cells).alias("cells"))
    reason = F.when(F.col("pairs") < 2, "insufficient_pairs").when(F.col("correlation").isNull(), "zero_variance")
    return row.select(*keys, F.explode("cells").alias("x")).select(*keys, "x.*").withColumn("reason", reason)


def candidate_diagnostics(wide: DataFrame, candidates: Sequence[str], active: Sequence[str], size: int = 20) -> DataFrame:
    """Coverage, redundancy, stability, turnover and verdict per candidate feature (MON03).

    ``wide`` has formation_date, security_id and one percentile column per feature. It is read once for each
    diagnostic, so its columns are written to the shared checkpoint folder.
    """
    wide = cut_lineage(wide.select("formation_date", "security_id", *candidates, *[a for a in active if a not in candidates]))
    long = wide.select("formation_date", "security_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature_key"), F.col(c).alias("value")) for c in candidates])).alias("x")).select("formation_date", "security_id", "x.*")
    monthly = feature_coverage(long)
    coverage = monthly.groupBy("feature_key").agg(
        F.sum("available").alias("available"), (F.sum("available") / F.sum("universe")).alias("aggregate_coverage"), F.min("coverage").alias("minimum_coverage"))
    pairs = feature_correlations(wide, [*candidates, *active], ["formation_date"]).where(
        F.col("left_key").isin(*candidates) & F.col("right_key").isin(*active) & F.col("correlation").isNotNull())
    medians = exact_quantiles(pairs.withColumn("a", F.abs("correlation")), ["left_key", "right_key"], "a", {"m": 0.5})
    redundancy = medians.groupBy(F.col("left_key").alias("feature_key")).agg(F.max("m").alias("redundancy"))
    ordered = Window.partitionBy(F.lit(1)).orderBy("formation_date")
    dates = wide.select("formation_date").distinct().withColumn("_next", F.lead("formation_date").over(ordered))
    known = long.where("value IS NOT NULL")
    later = known.select("feature_key", F.col("formation_date").alias("_next"), "security_id", F.col("value").alias("later"))
    steps = known.join(dates, "formation_date").join(later, ["feature_key", "_next", "security_id"]).groupBy("feature_key", "formation_date").agg(
        correlation("value", "later").alias("c"))
    stability = exact_quantiles(steps, ["feature_key"], "c", {"stability": 0.5})
    churn = exact_quantiles(top_turnover(known.withColumnRenamed("value", "prediction"), size, ["feature_key"]), ["feature_key"], "turnover", {"turnover": 0.5})
    rows = coverage.join(redundancy, "feature_key", "left").join(stability, "feature_key", "left").join(churn, "feature_key", "left")
    g = CANDIDATE_GATES
    reasons = F.array_compact(F.array(
        F.when(F.col("aggregate_coverage") < g["aggregate"], "aggregate_coverage_below_90_percent"),
        F.when(F.col("minimum_coverage") < g["monthly"], "monthly_coverage_below_80_percent"),
        F.when(F.col("redundancy").isNull(), "active_feature_redundancy_unavailable").when(F.col("redundancy") > g["redundancy"], "redundant_with_active_feature"),
        F.when(F.col("stability").isNull(), "rank_stability_unavailable").when(F.col("stability") < g["stability"], "rank_stability_below_0_10"),
        F.when(F.col("turnover").isNull(), "top_20_turnover_unavailable").when(F.col("turnover") > g["turnover"], "median_top_20_turnover_above_0_90")))
    return rows.withColumn("reasons", F.array_join(reasons, ",")).withColumn("accepted", F.size(reasons) == 0)


def binned(df: DataFrame, keys: Sequence[str], value: str, side: str, *more: Column) -> DataFrame:
    """Per key how many values lie in each of ten fixed bins, as columns ``side0`` to ``side9``, and ``more`` aggregates."""
    bin_ = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col(value) * 10)))
    return df.groupBy(*keys).agg(*more, *[F.count_if(F.col(value).isNotNull() & (bin_ == b)).alias(f"{side}{b}") for b in range(10)])


def index_of_bins(current: Column, reference: Column) -> Column:
    """Population stability index from the columns of :func:`binned`, sides c and r; null under 100 observations on a side."""
    total = F.lit(0.0)
    for b in range(10):
        share = lambda side, n: F.greatest(F.lit(FLOOR), safe_divide(F.coalesce(F.col(f"{side}{b}"), F.lit(0)), n))  # noqa: E731, B023
        now, then = share("c", current), share("r", reference)
        total = total + (now - then) * F.ln(now / then)
    return F.when((current >= MINIMUM_OBSERVATIONS) & (reference >= MINIMUM_OBSERVATIONS), total)


def stability_index(current: DataFrame, reference: DataFrame, keys: Sequence[str], value: str = "percentile") -> DataFrame:
    """Population stability index on ten fixed bins, null under 100 observations on a side (MON04)."""
    side = lambda df, letter, name: binned(df.where(F.col(value).isNotNull()), keys, value, letter, F.count(F.lit(1)).alias(name))
    counts = side(current, "c", "current_observations").join(side(reference, "r", "reference_observations"), list(keys), "full")
    return counts.select(*keys, "current_observations", "reference_observations", index_of_bins(F.col("current_observations"), F.col("reference_observations")).alias("psi"))


def feature_health(current: DataFrame, reference: DataFrame, keys: Sequence[str] = ("feature_key",)) -> DataFrame:
    """Missing ratio, means, PSI and status per feature (MON05), one aggregation a side. ``current`` holds the whole cohort."""
    now = binned(current, keys, "percentile", "c", F.count(F.lit(1)).alias("cohort"), F.count("percentile").alias("available"), F.avg("percentile").alias("mean_percentile"))
    then = binned(reference, keys, "percentile", "r", F.count("percentile").alias("_observations"), F.avg("percentile").alias("reference_mean"))
    rows = now.join(then, list(keys), "left").withColumn("psi", index_of_bins(F.col("available"), F.col("_observations"))).withColumn(
        "missing_ratio", 1 - F.col("available") / F.col("cohort"))
    missing, psi = F.col("missing_ratio"), F.col("psi")
    above = lambda limit_missing, limit_psi: (missing > limit_missing) | F.coalesce(psi > limit_psi, F.lit(False))
    status = F.when(above(MISSING[1], DRIFT[1]), "critical").when(above(MISSING[0], DRIFT[0]), "warning").when(psi.isNull(), "insufficient_reference").otherwise("healthy")
    return rows.select(*keys, "cohort", "available", "missing_ratio", "mean_percentile", "reference_mean", "psi", status.alias("status"))


def rank_churn(scores: DataFrame, size: int = 20) -> DataFrame:
    """Top-basket churn and mean normalised rank change against the previous date (MON06)."""
    ordered = Window.partitionBy(F.lit(1)).orderBy("score_date")
    sizes = scores.groupBy("score_date").agg(F.count(F.lit(1)).alias("n")).withColumn("previous_date", F.lag("score_date").over(ordered)).withColumn(
        "previous_n", F.lag("n").over(ordered))
    before = scores.select(F.col("score_date").alias("previous_date"), "security_id", F.col("score_rank").alias("previous_rank"))
    rows = scores.join(sizes.where("previous_date IS NOT NULL"), "score_date").join(before, ["previous_date", "security_id"])
    basket = F.least(F.lit(size), F.col("n"), F.col("previous_n"))
    kept = (F.col("score_rank") <= basket) & (F.col("previous_rank") <= basket)
    moved = F.abs(F.col("score_rank") / F.col("n") - F.col("previous_rank") / F.col("previous_n"))
    return rows.groupBy("score_date").agg(
        F.max("previous_date").alias("previous_date"), (1 - F.count_if(kept) / F.max(basket)).alias("churn"), F.avg(moved).alias("rank_change"))


def health_alerts(features: DataFrame, summary: DataFrame) -> DataFrame:
    """Alert rows from feature metrics and the run summary, ordered by severity (MON07).

    ``summary`` has coverage, churn, rank_change, lineage_matches, readiness_available.
    """
    level = lambda value, limits: F.when(value > limits[1], "critical").when(value > limits[0], "warning")
    alert = lambda code, metric, severity: F.when(severity.isNotNull(), F.struct(F.lit(code).alias("code"), metric.alias("metric"), severity.alias("severity")))
    per_feature = features.select(F.explode(F.array_compact(F.array(
        alert("feature_missingness", F.col("feature_key"), level(F.col("missing_ratio"), MISSING)),
        alert("feature_drift", F.col("feature_key"), level(F.col("psi"), DRIFT))))).alias("x"))
    coverage = F.when(F.col("coverage") < COVERAGE[1], "critical").when(F.col("coverage") < COVERAGE[0], "warning")
    warn = lambda rule, text="warning": F.when(rule, F.lit(text))
    overall = summary.select(F.explode(F.array_compact(F.array(
        alert("coverage", F.lit("eligible_coverage"), coverage),
        alert("rank_churn", F.lit("top_20_churn_ratio"), warn(F.col("churn") > CHURN)),
        alert("rank_churn", F.lit("mean_normalized_rank_change"), warn(F.col("rank_change") > RANK_CHANGE)),
        alert("explanation_lineage_mismatch", F.lit("score_explanations"), warn(~F.col("lineage_matches"), "critical")),
        alert("forward_readiness_missing", F.lit("forward_outcome_readiness"), warn(~F.col("readiness_available")))))).alias("x"))
    return per_feature.unionByName(overall).select("x.severity", "x.code", "x.metric").orderBy("severity", "code", "metric")


def reference_dates(scores: DataFrame, day: Column, count: int = REFERENCE_DATES) -> DataFrame:
    """The last ``count`` scored dates before a day (MON08)."""
    return scores.where(F.col("score_date") < day).select("score_date").distinct().orderBy(F.col("score_date").desc()).limit(count)


def exclusion_code(reason: Column) -> Column:
    """Reason text to a code by keyword precedence, else a slug of at most 80 characters (MON09)."""
    text = F.lower(reason)
    has = lambda *words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    slug = F.substring(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)
    return (
        F.when(F.coalesce(reason, F.lit("")) == "", "unspecified_exclusion")
        .when(has("required_feature_rank_unavailable"), "required_active_input_unavailable")
        .when(has("price", "session", "split-adjusted"), "price_history_unavailable").when(has("sector"), "sector_unavailable")
        .when(has("filing", "asset", "income", "shares"), "fundamental_input_unavailable")
        .otherwise(F.when(slug != "", slug).otherwise("other_exclusion")))


def freshness_alerts(runs: DataFrame, latest_price: DataFrame, expected: Column) -> DataFrame:
    """Stale data, eligible-count drop and mean-score shift from the last two runs (MON10).

    ``runs`` has score_date, eligible_count, mean_score; ``latest_price`` one row with session_date.
    """
    newest = Window.partitionBy(F.lit(1)).orderBy(F.col("score_date").desc())
    two = runs.withColumn("_n", F.row_number().over(newest)).where("_n <= 2")
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    row = two.agg(at(1, "score_date").alias("day"), at(1, "eligible_count").alias("now"), at(2, "eligible_count").alias("before"),
                  at(1, "mean_score").alias("mean_now"), at(2, "mean_score").alias("mean_before"))
    row = row.crossJoin(F.broadcast(latest_price))
    found = F.array_compact(F.array(
        F.when(F.col("session_date").isNull() | (F.col("session_date") < expected), "stale_market_data"), F.when(F.col("day").isNull() | (F.col("day") < expected), "stale_scores"),
        F.when(F.col("now") < 1, "insufficient_eligible_scores"), F.when(safe_divide(F.col("before") - F.col("now"), F.col("before")) > 0.30, "eligible_count_drop"),
        F.when(F.abs(F.col("mean_now") - F.col("mean_before")) > 20, "mean_score_shift")))
    return row.select(F.explode(found).alias("alert"))


def market_coverage(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows, sessions, companies, range and missing company-sessions per basis (MON11)."""
    total = sessions.agg(F.count(F.lit(1)).alias("_s"))
    late = F.count_if(F.col("available_at") < F.col("session_date").cast("timestamp"))
    companies = bars.groupBy("basis", "security_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct("session_date").alias("_have"), F.min("session_date").alias("_first"), F.max("session_date").alias("_last"), late.alias("_late"))
    per_basis = companies.groupBy("basis").agg(
        F.sum("_rows").alias("rows_count"), F.count(F.lit(1)).alias("companies"), F.min("_first").alias("first_session"), F.max("_last").alias("last_session"),
        F.sum("_have").alias("_have"), F.sum("_late").alias("wrong_availability"))
    return per_basis.crossJoin(F.broadcast(total)).withColumn(
        "missing_company_sessions", F.col("companies") * F.col("_s") - F.col("_have")).drop("_s", "_have")


def fact_inventory(facts: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """Facts and distinct periods per company and concept, zero where a company lacks one (MON12).

    Companies already seen are unfolded over the fixed concept list; nothing is cross joined.
    """
    per = facts.groupBy("security_id").agg(*[x for c in concepts for x in (
        F.count_if(F.col("concept") == c).alias(f"n_{c}"), F.count_distinct(F.when(F.col("concept") == c, F.col("period_end"))).alias(f"p_{c}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(f"n_{c}").alias("facts"), F.col(f"p_{c}").alias("periods")) for c in concepts])
    return per.select("security_id", F.explode(cells).alias("x")).select("security_id", "x.*", (F.col("x.facts") == 0).alias("missing_concept"))


def action_coverage(chunks: DataFrame, actions: DataFrame) -> DataFrame:
    """Chunk completion and action counts of a backfill, with the readiness verdict (MON13)."""
    done = chunks.agg(F.count(F.lit(1)).alias("requested_chunks"), F.count_if(F.col("status") == "completed").alias("completed_chunks"),
                      F.count_if((F.col("status") == "completed") & ~F.col("has_document")).alias("without_document"))
    found = actions.agg(F.count(F.lit(1)).alias("action_count"))
    ready = (F.col("requested_chunks") > 0) & (F.col("requested_chunks") == F.col("completed_chunks")) & (F.col("without_document") == 0) & (F.col("action_count") > 0)
    return done.crossJoin(F.broadcast(found)).withColumn("coverage_ready", ready)


def complete_fiscal_years(facts: DataFrame) -> DataFrame:
    """Years with all of Q1, Q2, Q3 and FY, per concept (MON14, SET09)."""
    sets = facts.groupBy("security_id", "concept", "fiscal_year").agg(F.collect_set("fiscal_period").alias("p"))
    wanted = F.array(*[F.lit(x) for x in ("Q1", "Q2", "Q3", "FY")])
    return sets.groupBy("concept").agg(F.count(F.lit(1)).alias("years"), F.count_if(F.size(F.array_intersect("p", wanted)) == 4).alias("complete_years"))


def history_share(bars: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Names per session with at least n own sessions so far (MON14)."""
    own = Window.partitionBy("security_id").orderBy("session_date")
    counted = bars.withColumn("_n", F.row_number().over(own))
    return counted.groupBy("session_date").agg(F.count(F.lit(1)).alias("names"), *[F.count_if(F.col("_n") >= n).alias(f"with_{n}") for n in lengths])


def backfill_chunks(symbols: DataFrame, dates: DataFrame, bases: Sequence[str], batch: int = 100) -> DataFrame:
    """Quarter ranges x symbol batches x bases with a stable key (MON17).

    ``symbols`` has a dense ``place`` from 0; ``dates`` holds the covered days.
    """
    quarters = dates.groupBy(F.date_trunc("quarter", "day").alias("_q")).agg(F.min("day").alias("range_start"), F.max("day").alias("range_end")).drop("_q")
    batches = symbols.groupBy(F.floor(F.col("place") / batch).cast("int").alias("batch")).agg(F.min("ticker").alias("first_ticker"), F.max("ticker").alias("last_ticker"), F.count(F.lit(1)).alias("symbols"))
    spans = quarters.agg(F.array_sort(F.collect_list(F.struct("range_start", "range_end"))).alias("q"))
    plan = batches.crossJoin(F.broadcast(spans)).withColumn("x", F.explode("q")).withColumn("basis", F.explode(F.array(*[F.lit(b) for b in bases])))
    key = F.sha2(F.concat_ws("|", F.col("x.range_start").cast("string"), F.col("x.range_end").cast("string"), "first_ticker", "last_ticker", "basis"), 256)
    return plan.select("batch", "x.range_start", "x.range_end", "basis", "symbols", "first_ticker", "last_ticker", key.alias("chunk_key"))


def canonical_tickers(listings: DataFrame) -> DataFrame:
    """Preferred ticker per company: simple common, then class B, then shortest, then first (MON18)."""
    t = F.upper(F.trim("ticker"))
    order = F.struct(~t.rlike("^[A-Z]{1,5}$"), ~t.rlike("^[A-Z]+-B$"), F.length(t), t)
    return listings.where(F.length(F.trim("ticker")) > 0).groupBy("security_id").agg(F.min_by(t, order).alias("ticker"))


def evidence_report(health: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels and relative returns per horizon with the newest health status (MON15)."""
    newest = health.agg(F.max_by("status", "score_date").alias("latest_status"))
    done = F.col("status") == "completed"
    rows = labels.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(done).alias("completed"), F.count_if(~done).alias("withheld"),
        F.avg("relative_return").alias("mean_relative"), (F.count_if(F.col("relative_return") > 0) / F.count_if(done)).alias("share_ahead"))
    reconciled = F.col("labels") == F.col("completed") + F.col("withheld")
    return rows.withColumn("reconciles", reconciled).crossJoin(F.broadcast(newest))
