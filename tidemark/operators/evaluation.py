"""Evaluation metrics: rank correlation, spreads, stability, bootstrap, segments, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, exact_quantiles, with_position, with_tie_ranks
from ..session import cut_lineage

DATE = ["model_key", "formation_date"]
BLOCK_MONTHS = 3
MODULUS = 2147483647


def zero_if_flat(value: Column) -> Column:
    """Correlation with no variance or fewer than two rows counts as zero."""
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def correlation(left: Column | str, right: Column | str) -> Column:
    """Pearson correlation over rows where both sides are known; null where a side is flat, which ``corr`` fails on."""
    left, right = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    both = left.isNotNull() & right.isNotNull()
    left, right = F.when(both, left), F.when(both, right)
    return F.try_divide(F.covar_pop(left, right), F.stddev_pop(left) * F.stddev_pop(right))


def pearson(rows: DataFrame, keys: Sequence[str], left: str, right: str, name: str) -> DataFrame:
    """Plain correlation per group, zero when undefined (EVL02)."""
    return rows.groupBy(*keys).agg(zero_if_flat(correlation(left, right)).alias(name), F.count(F.lit(1)).alias("pairs"))


def spearman(rows: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "rank_ic") -> DataFrame:
    """Correlation of tie-averaged ranks per group (EVL01). ``rows`` are read three times."""
    drop = ("below", "ties", "total")
    pairs = rows.select(*keys, left, right)
    ranked = with_tie_ranks(pairs, keys, left).withColumn("_l", average_rank()).drop(*drop)
    ranked = with_tie_ranks(ranked, keys, right, source=pairs).withColumn("_r", average_rank())
    return pearson(ranked, keys, "_l", "_r", name)


def monthly_mean(daily: DataFrame, value: str) -> DataFrame:
    """Mean of dates within a month, then of months (EVL03)."""
    months = daily.groupBy("model_key", F.date_trunc("month", "formation_date").cast("date").alias("month")).agg(F.avg(value).alias("_v"))
    return months.groupBy("model_key").agg(F.avg("_v").alias(f"monthly_{value}"), F.count(F.lit(1)).alias("months"))


def decile_spread(rows: DataFrame, keys: Sequence[str] = DATE) -> DataFrame:
    """Top minus bottom max(1, n div 10) names by (prediction, id) (EVL04)."""
    placed = with_position(rows, keys, "prediction", "security_id", position="_p", size="_n")
    width = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    top, bottom = F.col("_p") > F.col("_n") - width, F.col("_p") <= width
    return placed.groupBy(*keys).agg((F.avg(F.when(top, F.col("actual"))) - F.avg(F.when(bottom, F.col("actual")))).alias("spread"))


def decile_report(rows: DataFrame) -> DataFrame:
    """Pooled means by decile = min(10, i x 10 div n + 1) within each date (EVL05)."""
    placed = with_position(rows, DATE, "prediction", "security_id", position="_p", size="_n")
    decile = F.least(F.lit(10), F.floor((F.col("_p") - 1) * 10 / F.col("_n")) + 1).cast("int")
    return placed.groupBy("model_key", decile.alias("decile")).agg(
        F.count(F.lit(1)).alias("rows_count"), F.avg("prediction").alias("mean_prediction"), F.avg("actual").alias("mean_actual"))


def error_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, MAE, bias, directional accuracy, calibration line and range (EVL06)."""
    error = F.col("prediction") - F.col("actual")
    hit = F.signum("prediction") == F.signum("actual")
    return rows.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"),
        (F.count_if(hit) / F.count(F.lit(1))).alias("directional_accuracy"), F.regr_slope("actual", "prediction").alias("slope"),
        F.regr_intercept("actual", "prediction").alias("intercept"), (F.max("prediction") - F.min("prediction")).alias("prediction_range"))


def consecutive(rows: DataFrame, keys: Sequence[str] = ("model_key",)) -> DataFrame:
    """Each formation's rows with the same security's value at the next formation."""
    ordered = Window.partitionBy(*keys).orderBy("formation_date")
    following = rows.select(*keys, "formation_date").distinct().withColumn("_next", F.lead("formation_date").over(ordered)).where("_next IS NOT NULL")
    later = rows.select(*keys, F.col("formation_date").alias("_next"), "security_id", F.col("prediction").alias("later"))
    return rows.join(following, [*keys, "formation_date"]).join(later, [*keys, "_next", "security_id"])


def rank_stability(rows: DataFrame, minimum: int = 20) -> DataFrame:
    """Spearman of predictions between consecutive formations over at least ``minimum`` common names (EVL08)."""
    pairs = cut_lineage(consecutive(rows).select(*DATE, "prediction", "later"))
    found = spearman(pairs, DATE, "prediction", "later", "stability").where(F.col("pairs") >= minimum)
    return found.groupBy("model_key").agg(F.avg("stability").alias("mean_stability"), F.count(F.lit(1)).alias("transitions"))


def top_names(rows: DataFrame, size: int, keys: Sequence[str] = DATE) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col("prediction").desc(), "security_id")
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= size).drop("_r")


def top_turnover(rows: DataFrame, size: int, keys: Sequence[str] = ("model_key",)) -> DataFrame:
    """1 - retained / selected of the top names between consecutive formations (EVL09)."""
    top = top_names(rows, size, [*keys, "formation_date"]).select(*keys, "formation_date", "security_id")
    ordered = Window.partitionBy(*keys).orderBy("formation_date")
    dates = top.groupBy(*keys, "formation_date").agg(F.count(F.lit(1)).alias("selected")).withColumn("_next", F.lead("formation_date").over(ordered))
    carried = top.join(dates.drop("selected"), [*keys, "formation_date"]).where("_next IS NOT NULL").select(
        *keys, F.col("_next").alias("formation_date"), "security_id")
    kept = top.join(carried, [*keys, "formation_date", "security_id"], "left_semi").groupBy(*keys, "formation_date").agg(F.count(F.lit(1)).alias("retained"))
    has_prior = dates.where("_next IS NOT NULL").select(*keys, F.col("_next").alias("formation_date"))
    sized = dates.select(*keys, "formation_date", "selected").join(has_prior, [*keys, "formation_date"], "left_semi")
    return sized.join(kept, [*keys, "formation_date"], "left").select(
        *keys, "formation_date", (1 - F.coalesce("retained", F.lit(0)) / F.col("selected")).alias("turnover"))


def last_of_month(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("model_key", F.date_trunc("month", "formation_date").alias("_m")).agg(F.max("formation_date").alias("formation_date"))
    return rows.join(last.drop("_m"), DATE, "left_semi")


def monthly_formation_report(rows: DataFrame, size: int = 20) -> DataFrame:
    """Top names on each month's last date: mean outcome and share beating the benchmark (EVL10)."""
    return top_names(last_of_month(rows), size).groupBy(*DATE).agg(
        F.count(F.lit(1)).alias("names"), F.avg("actual").alias("mean_actual"), (F.count_if(F.col("actual") > 0) / F.count(F.lit(1))).alias("share_ahead"))


def metrics_bundle(rows: DataFrame, cost_bps: float = 25.0, size: int = 20) -> DataFrame:
    """IC, spread, stability, monthly turnover, net return and errors per model (EVL07, EVL11).

    The rows are written once: every metric reads them.
    """
    rows = cut_lineage(rows.select(*DATE, "security_id", "prediction", "actual"))
    ic = spearman(rows, DATE, "prediction", "actual")
    daily = ic.groupBy("model_key").agg(F.avg("rank_ic").alias("mean_ic"), (F.count_if(F.col("rank_ic") > 0) / F.count(F.lit(1))).alias("positive_share"))
    spread = decile_spread(rows).groupBy("model_key").agg(F.avg("spread").alias("mean_spread"))
    month_ends = last_of_month(rows)
    churn = top_turnover(month_ends, size).groupBy("model_key").agg(F.avg("turnover").alias("monthly_turnover"))
    gross = monthly_formation_report(rows, size).groupBy("model_key").agg(F.avg("mean_actual").alias("monthly_gross"))
    errors = error_metrics(rows, ["model_key"]).select("model_key", "mae", "rmse")
    out = daily
    for part in (spread, rank_stability(rows), churn, gross, errors):
        out = out.join(part, "model_key", "left")
    return out.withColumn("monthly_net", F.col("monthly_gross") - F.col("monthly_turnover") * cost_bps / 10000.0)


def mix(value: Column) -> Column:
    """Two multiplicative-congruential steps: a portable integer hash below 2^31 - 1."""
    return (value % MODULUS * 48271 % MODULUS) * 69621 % MODULUS


def moving_block_bootstrap(deltas: DataFrame, seed: int, resamples: int = 10_000, block: int = BLOCK_MONTHS) -> DataFrame:
    """Circular block bootstrap of a monthly series: mean, P(> 0), 95 % interval (EVL12).

    ``deltas`` has month, delta: one row per month. Draws are hash-seeded, so a re-run task
    repeats its own draws.
    """
    ordered = Window.partitionBy(F.lit(1)).orderBy("month")
    series = deltas.select((F.row_number().over(ordered) - 1).alias("i"), "delta", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))
    size = series.agg(F.max("n").alias("n")).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    places = size.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    start = mix(F.col("resample").cast("long") * 1000003 + F.floor(F.col("k") / block) * 7919 + F.lit(seed)) % F.col("n")
    drawn = places.select("resample", ((start + F.col("k") % block) % F.col("n")).cast("int").alias("i")).join(series.select("i", "delta"), "i")
    means = drawn.groupBy("resample").agg(F.avg("delta").alias("mean")).withColumn("g", F.lit(1))
    spread = exact_quantiles(means, ["g"], "mean", {"low": 0.025, "high": 0.975})
    summary = means.groupBy("g").agg(F.avg("mean").alias("bootstrap_mean"), (F.count_if(F.col("mean") > 0) / F.count(F.lit(1))).alias("probability_positive"))
    return summary.join(spread, "g").drop("g")


def sign_stability(coefficients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Folds agreeing with the majority sign of a coefficient (EVL13)."""
    positive, negative = F.count_if(F.col("coefficient") > 0), F.count_if(F.col("coefficient") < 0)
    return coefficients.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.greatest(positive, negative).alias("consistent"))


def portfolio_gate(rows: DataFrame, cost_bps: float = 25.0, size: int = 20) -> DataFrame:
    """Candidate minus reference: net return, turnover and blocks won, from month-end baskets (EVL14)."""
    month_ends = last_of_month(rows)
    gross = monthly_formation_report(rows, size).select(*DATE, "mean_actual")
    net = gross.join(top_turnover(month_ends, size), DATE, "left").withColumn("turnover", F.coalesce("turnover", F.lit(1.0))).withColumn(
        "net", F.col("mean_actual") - F.col("turnover") * cost_bps / 10000.0).withColumn("block", F.year("formation_date"))
    of = lambda model, c: F.max(F.when(F.col("model_key") == model, F.col(c)))
    paired = net.groupBy("block", "formation_date").agg(
        (of("candidate", "net") - of("reference", "net")).alias("delta"), (of("candidate", "turnover") - of("reference", "turnover")).alias("turnover_delta"))
    return paired.groupBy("block").agg(F.count("delta").alias("months"), F.avg("delta").alias("mean_net_delta"), F.avg("turnover_delta").alias("mean_turnover_delta"))


def regime_diagnostics(daily: DataFrame, regimes: DataFrame) -> DataFrame:
    """Mean IC and spread by regime with each regime's share of formations (EVL15)."""
    rows = daily.join(regimes, "formation_date", "left").withColumn("regime", F.coalesce("regime", F.lit("unavailable")))
    totals = daily.groupBy("model_key").agg(F.count(F.lit(1)).alias("_t"))
    return rows.groupBy("model_key", "regime").agg(
        F.count(F.lit(1)).alias("formations"), F.avg("rank_ic").alias("mean_ic"), F.avg("spread").alias("mean_spread")).join(totals, "model_key").select(
        "model_key", "regime", "formations", "mean_ic", "mean_spread", (F.col("formations") / F.col("_t")).alias("share"))


def segment_analysis(rows: DataFrame, dimensions: Sequence[str], minimum: int = 5) -> DataFrame:
    """Errors by segment of several dimensions in one pass, with the gap to the overall error (EVL16)."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("segment")) for d in dimensions])
    error = F.col("prediction") - F.col("actual")
    aggregates = [F.count(F.lit(1)).alias("observations"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias")]
    long = rows.select("prediction", "actual", F.explode(cells).alias("x"))
    parts = long.groupBy("x.dimension", "x.segment").agg(*aggregates, zero_if_flat(correlation("prediction", "actual")).alias("_c"))
    overall = rows.agg(F.avg(F.abs(error)).alias("_all"))
    return parts.crossJoin(F.broadcast(overall)).select(
        "dimension", "segment", "observations", "mae", "bias", F.when(F.col("observations") >= minimum, F.col("_c")).alias("correlation"),
        (F.col("mae") - F.col("_all")).alias("mae_delta"))


def correlation_matrix(wide: DataFrame, features: Sequence[str], redundancy: float = 0.95) -> DataFrame:
    """Every pairwise correlation over rows where both are present, in one aggregation (EVL17)."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))
    row = wide.agg(*[F.struct(
        F.lit(a).alias("left_key"), F.lit(b).alias("right_key"), F.count(both(a, b)).alias("pairs"), correlation(a, b).alias("correlation")).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("x")).select("x.*").withColumn(
        "redundant", F.coalesce(F.abs("correlation") >= redundancy, F.lit(False)))


def gate_table(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Metric against frozen threshold, pass or fail, with the overall verdict (EVL18).

    ``metrics`` is long (metric, value); ``gates`` has metric, comparison, threshold.
    """
    rows = gates.join(metrics, "metric", "left")
    passed = F.when(F.col("comparison") == "at_least", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    rows = rows.withColumn("passed", F.coalesce(passed, F.lit(False)))
    verdict = F.min("passed").over(Window.partitionBy(F.lit(1)))
    return rows.select("metric", "comparison", "threshold", "value", "passed", F.when(verdict, "freeze").otherwise("no_freeze").alias("decision"))


def paired_deltas(rows: DataFrame) -> DataFrame:
    """Monthly rank-IC of the candidate minus the reference (EVL19)."""
    ic = spearman(rows, DATE, "prediction", "actual")
    months = ic.groupBy("model_key", F.date_trunc("month", "formation_date").cast("date").alias("month")).agg(F.avg("rank_ic").alias("_v"))
    of = lambda model: F.max(F.when(F.col("model_key") == model, F.col("_v")))
    return months.groupBy("month").agg((of("candidate") - of("reference")).alias("delta")).where("delta IS NOT NULL")
