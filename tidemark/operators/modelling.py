"""Datasets, folds and small linear models.

A fit is one partial aggregation of weighted moments on Spark, k(k+1)/2 numbers per fold,
followed by a k x k solve on the driver. Iterative fits repeat that aggregation; nothing but
moments ever leaves the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles, with_position, with_tie_ranks, tie_percentile
from ..session import cut_lineage

# Holdout window and fold geometry.
HOLDOUT = ("2025-07-01", "2026-06-30")
PAIRS_PER_FORMATION = 64
MAD_TO_SIGMA = 1.4826
#: A squared mean above so many variances costs the sums of squares too many digits.
CONDITION = 1e5


# ---- datasets ------------------------------------------------------------------
def complete_wide(ranks: DataFrame, features: Sequence[str], labels: DataFrame) -> DataFrame:
    """One row per snapshot holding every feature, joined with its label (MDL01)."""
    wide = ranks.where(F.col("percentile").isNotNull()).groupBy("formation_date", "security_id").pivot("feature_key", list(features)).agg(F.max("percentile"))
    whole = F.lit(True)
    for name in features:
        whole = whole & F.col(name).isNotNull()
    return wide.where(whole).join(labels, ["formation_date", "security_id"])


def long_training_rows(ranks: DataFrame, labels: DataFrame) -> DataFrame:
    """Snapshot x feature x label rows (MDL02)."""
    return ranks.where(F.col("percentile").isNotNull()).join(labels, ["formation_date", "security_id"])


def feature_set_report(ranks: DataFrame, labels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Examples, long rows and how many examples lack the full feature set (MDL02).

    A feature is one bit (any other key is bit 0) before the rows are joined, so rows are short and an example needs one
    group, not one for each of its features.
    """
    if len(features) > 62:
        raise ValueError("at most 62 features")
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature_key")).cast("int")
    bits = ranks.select("formation_date", "security_id", "percentile", F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("_f"))
    per = long_training_rows(bits, labels).groupBy("formation_date", "security_id").agg(F.bit_or("_f").alias("_f"), F.count(F.lit(1)).alias("_r"))
    full = F.lit(sum(1 << i for i in range(1, len(features) + 1))).cast("long")
    return per.agg(F.count(F.lit(1)).alias("examples"), F.sum("_r").alias("rows_count"), F.count_if(~F.col("_f").eqNullSafe(full)).alias("incomplete_examples"))


def partition_tag(day: Column, start: str = HOLDOUT[0], end: str = HOLDOUT[1]) -> Column:
    """holdout inside the reserved window, else development (MDL03)."""
    return F.when(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), "holdout").otherwise("development")


def formation_weights(rows: DataFrame) -> DataFrame:
    """Weights that sum to one within each formation (MDL06)."""
    counts = rows.groupBy("formation_date").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return rows.join(counts, "formation_date")


def covered_formations(panel: DataFrame, labels: DataFrame, minimum: float = 0.90) -> DataFrame:
    """Panel x labels, dropping formations whose label coverage is too low; ranks and weights added (MDL09)."""
    keys = ["formation_date", "security_id"]
    joined = panel.join(labels, keys, "left")
    kept = joined.groupBy("formation_date").agg(
        F.count("target").alias("labelled"), F.count(F.lit(1)).alias("_n")).where(F.col("labelled") / F.col("_n") >= minimum).drop("_n")
    rows = joined.where("target IS NOT NULL").join(kept, "formation_date")
    ranked = with_tie_ranks(rows, ["formation_date"], "target").where("total >= 2")
    return ranked.select(*keys, "target", (tie_percentile() * 2 - 1).alias("label_rank"), (F.lit(1.0) / F.col("labelled")).alias("sample_weight"))


def written_audit(recomputed: DataFrame, written: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Rows missing on either side and rows whose hash differs after a round trip (MDL10)."""
    both = recomputed.select(*keys, F.col(digest).alias("_a")).join(written.select(*keys, F.col(digest).alias("_b")), list(keys), "full")
    return both.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_b").isNull()).alias("missing_written"), F.count_if(F.col("_a").isNull()).alias("unexpected_written"),
        F.count_if(F.col("_a") != F.col("_b")).alias("hash_mismatches"))


def residual_rows(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """Label rank minus out-of-fold anchor rank (MDL11)."""
    return labels.join(anchors, ["formation_date", "security_id"]).withColumn("residual", F.col("label_rank") - F.col("anchor_rank"))


# ---- folds: every frame is bounded by the number of dates -----------------------
def date_index(dates: DataFrame) -> DataFrame:
    ordered = Window.partitionBy(F.lit(1)).orderBy("formation_date")
    return dates.select("formation_date").distinct().select(
        "formation_date", (F.row_number().over(ordered) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))


def time_ordered_folds(dates: DataFrame, folds: int, validation: int, purge: int) -> DataFrame:
    """The last folds x validation dates as blocks, each preceded by a purge gap (MDL12)."""
    first = F.col("n") - folds * validation
    block = date_index(dates).where(F.col("i") >= first).withColumn("fold", (F.floor((F.col("i") - first) / validation) + 1).cast("int"))
    bounds = block.groupBy("fold").agg(F.min("formation_date").alias("validation_start"), F.max("formation_date").alias("validation_end"), F.min("i").alias("_start"))
    ends = date_index(dates).select((F.col("i") + purge + 1).alias("_start"), F.col("formation_date").alias("training_end"))
    return bounds.join(ends, "_start").select("fold", "training_end", "validation_start", "validation_end")


def expanding_folds(dates: DataFrame, minimum: int, validation: int, step: int | None = None) -> DataFrame:
    """Expanding training history with stepped validation windows (MDL13)."""
    step = step or validation
    starts = date_index(dates).where((F.col("i") >= minimum) & ((F.col("i") - minimum) % step == 0) & (F.col("i") + validation <= F.col("n")))
    at = lambda name: date_index(dates).select(F.col("i").alias(f"_{name}"), F.col("formation_date").alias(name))
    rows = starts.select(
        ((F.col("i") - minimum) / step + 1).cast("int").alias("fold"), F.col("i").alias("training_dates"), F.col("formation_date").alias("validation_start"),
        (F.col("i") - 1).alias("_training_end"), (F.col("i") + validation - 1).alias("_validation_end"))
    return rows.join(at("training_end"), "_training_end").join(at("validation_end"), "_validation_end").drop("_training_end", "_validation_end")


def nested_folds(formations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Role of each formation per outer fold: train, purged or validation, by actual outcome date (MDL14).

    ``formations`` has formation_date, outcome_date; ``blocks`` has outer_fold, valid_from, valid_to.
    """
    rows = formations.join(blocks, F.col("formation_date") <= F.col("valid_to"))
    start = F.min(F.when(F.col("formation_date") >= F.col("valid_from"), F.col("formation_date"))).over(Window.partitionBy("outer_fold"))
    role = F.when(F.col("formation_date") >= F.col("valid_from"), "validation").when(F.col("outcome_date") < F.col("_start"), "train").otherwise("purged")
    return rows.withColumn("_start", start).select("outer_fold", "formation_date", "outcome_date", role.alias("role"))


def inner_folds(nested: DataFrame) -> DataFrame:
    """Last nine training months of each outer fold in three blocks, purged the same way (MDL14)."""
    train = nested.where("role = 'train'").withColumn("month", F.date_trunc("month", "formation_date").cast("date"))
    newest = Window.partitionBy("outer_fold").orderBy(F.col("month").desc())
    months = train.select("outer_fold", "month").distinct().withColumn("_r", F.row_number().over(newest)).where("_r <= 9").select(
        "outer_fold", "month", (3 - F.floor((F.col("_r") - 1) / 3)).cast("int").alias("inner_fold"))
    valid = train.join(months, ["outer_fold", "month"]).select("outer_fold", "inner_fold", "formation_date", "outcome_date", F.lit("validation").alias("role"))
    starts = valid.groupBy("outer_fold", "inner_fold").agg(F.min("formation_date").alias("_start"))
    before = train.join(starts, "outer_fold").where(F.col("formation_date") < F.col("_start"))
    role = F.when(F.col("outcome_date") < F.col("_start"), "train").otherwise("purged")
    return valid.unionByName(before.select("outer_fold", "inner_fold", "formation_date", "outcome_date", role.alias("role")))


def month_balanced(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Row weight divided by its month's total (MDL21)."""
    month = F.date_trunc("month", "formation_date")
    rows = rows.withColumn("_w", weight if weight is not None else F.lit(1.0)).withColumn("_m", month)
    totals = rows.groupBy("_m").agg(F.sum("_w").alias("_t"))
    return rows.join(totals, "_m").withColumn("weight", F.col("_w") / F.col("_t")).drop("_w", "_m", "_t")


# ---- fits -----------------------------------------------------------------------
@dataclass(frozen=True)
class Moments:
    """Weighted first and second moments of k features and a target."""

    total: float
    means: np.ndarray
    scales: np.ndarray
    target_mean: float
    gram: np.ndarray
    covariance: np.ndarray


def moments(rows: DataFrame, features: Sequence[str], target: str = "target", weight: str | None = None, keys: Sequence[str] = (),
            balance: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Moments per key (MDL15): standardised gram and covariance over the total weight.

    With ``balance``, the rows of each of its groups within a key share the weight of one (:func:`formation_weights`): sums are
    divided by the group's rows, so the rows are not read for their counts first.
    One aggregation. Only where a mean is so far above its spread that the sums lose digits (more than
    CONDITION times the variance), a second one sums products around the means found by the first.
    """
    names = [*features, target]
    w = F.col(weight) if weight else F.lit(1.0)
    groups = list(dict.fromkeys([*keys, *balance]))
    rows = rows.select(*groups, w.alias("_w"), *[F.col(a).cast("double").alias(a) for a in names])
    shift = dict.fromkeys(names, 0.0)
    sums = _moment_sums(rows, features, target, keys, shift, groups)
    total = sum(r["sw"] or 0.0 for r in sums)
    if total:
        mean = {a: sum(r[f"s_{a}"] or 0.0 for r in sums) / total for a in names}
        square = {a: sum(r[f"c_{a}_{a}"] or 0.0 for r in sums) / total for a in features}
        if any(mean[a] ** 2 > CONDITION * abs(square[a] - mean[a] ** 2) and np.isfinite(mean[a]) for a in features):
            shift = {a: mean[a] if np.isfinite(mean[a]) else 0.0 for a in names}
            sums = _moment_sums(rows, features, target, keys, shift, groups)
    found = {}
    for row in sums:
        total = row["sw"]
        if not total:
            continue
        mean = {a: row[f"s_{a}"] / total for a in names}
        central = lambda a, b: row[f"c_{a}_{b}"] / total - mean[a] * mean[b]
        scales = np.array([max(central(a, a), 0.0) ** 0.5 for a in features])
        scales = np.where(scales > 1e-12, scales, 1.0)
        gram = np.empty((len(features), len(features)))
        for i, a in enumerate(features):
            for k, b in enumerate(features[i:], start=i):
                gram[i, k] = gram[k, i] = central(a, b) / scales[i] / scales[k]
        covariance = np.array([central(a, target) for a in features]) / scales
        found[tuple(row[k] for k in keys)] = Moments(
            total, np.array([mean[a] + shift[a] for a in features]), scales, mean[target] + shift[target], gram, covariance)
    return found


def _moment_sums(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], shift: dict[str, float], groups: Sequence[str]) -> list:
    names, w = [*features, target], F.col("_w")
    rows = rows.select(*groups, "_w", *[(F.col(a) - F.lit(shift[a]) if shift[a] else F.col(a)).alias(a) for a in names])
    sums = [F.sum(w).alias("sw")] + [F.sum(w * F.col(a)).alias(f"s_{a}") for a in names]
    cross = [F.sum(w * F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[i:] if a != target]
    if list(groups) == list(keys):
        return rows.groupBy(*keys).agg(*sums, *cross).collect()
    per_group = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), *sums, *cross)
    found = [c for c in per_group.columns if c not in (*groups, "_rows")]
    return per_group.groupBy(*keys).agg(*[F.sum(F.col(c) / F.col("_rows")).alias(c) for c in found]).collect()


def solve(m: Moments, l1: float, l2: float, per_row: bool = True) -> np.ndarray:
    """Ridge for l1 = 0, else coordinate descent with a soft threshold.

    ``per_row`` penalises the averaged gram; otherwise the summed one (MDL21).
    """
    gram = m.gram if per_row else m.gram * m.total
    covariance = m.covariance if per_row else m.covariance * m.total
    if l1 == 0:
        return np.linalg.solve(gram + l2 * np.eye(len(covariance)), covariance)
    b = np.zeros(len(covariance))
    for _ in range(20000):
        before = b.copy()
        for i in range(len(b)):
            partial = covariance[i] - gram[i] @ b + gram[i, i] * b[i]
            b[i] = np.sign(partial) * max(abs(partial) - l1, 0.0) / (gram[i, i] + l2)
        if np.max(np.abs(b - before)) < 1e-10:
            return b
    raise RuntimeError("coordinate descent did not converge")


def coefficient_frame(spark, features: Sequence[str], fits: dict[tuple, tuple[Moments, np.ndarray]], keys: Sequence[str] = ()) -> DataFrame:
    """Fits as a small table: keys, feature, coefficient, mean, scale, intercept."""
    rows = [
        (*key, name, float(b[i]), float(m.means[i]), float(m.scales[i]), float(m.target_mean))
        for key, (m, b) in fits.items() for i, name in enumerate(features)
    ]
    types = ", ".join(f"{k} {'int' if 'fold' in k else 'string'}" for k in keys)
    return spark.createDataFrame(rows, f"{types + ', ' if types else ''}feature_key string, coefficient double, mean double, scale double, intercept double")


def fit(rows: DataFrame, features: Sequence[str], l1: float, l2: float, *, target: str = "target", weight: str | None = None,
        keys: Sequence[str] = (), per_row: bool = True) -> DataFrame:
    """Linear fits per key as a coefficient table (MDL15, MDL16, MDL21-23, MDL29)."""
    found = moments(rows, features, target, weight, keys)
    return coefficient_frame(rows.sparkSession, features, {k: (m, solve(m, l1, l2, per_row)) for k, m in found.items()}, keys)


def prediction(features: Sequence[str], m: Moments, b: np.ndarray) -> Column:
    total = F.lit(float(m.target_mean))
    for i, name in enumerate(features):
        total = total + F.lit(float(b[i])) * (F.col(name) - float(m.means[i])) / float(m.scales[i])
    return total


def fit_huber(rows: DataFrame, features: Sequence[str], l2: float, delta: float, *, weight: str | None = None, steps: int = 10) -> tuple[Moments, np.ndarray]:
    """Iteratively reweighted ridge with a MAD-scaled cutoff (MDL16 robust, MDL17).

    Each step is one aggregation plus one exact median of |residual| by distributed counting.
    Features keep their initial standardisation.
    """
    base = next(iter(moments(rows, features, weight=weight).values()))
    z = [((F.col(f) - float(base.means[i])) / float(base.scales[i])).alias(f"z{i}") for i, f in enumerate(features)]
    names = [f"z{i}" for i in range(len(features))]
    own = F.col(weight) if weight else F.lit(1.0)
    frame = cut_lineage(rows.select(*z, "target", own.alias("w0")))
    robust, b, centre = F.lit(1.0), np.zeros(len(features)), base.target_mean
    for _ in range(steps):
        effective = frame.withColumn("w", F.col("w0") * robust)
        sums = effective.agg(
            F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("target")).alias("sy"),
            *[F.sum(F.col("w") * F.col(a)).alias(f"s_{a}") for a in names],
            *[F.sum(F.col("w") * F.col(a) * F.col("target")).alias(f"y_{a}") for a in names],
            *[F.sum(F.col("w") * F.col(a) * F.col(c)).alias(f"c_{a}_{c}") for i, a in enumerate(names) for c in names[i:]]).first()
        centre = sums["sy"] / sums["sw"]
        gram = np.array([[sums[f"c_{min(a, c)}_{max(a, c)}"] / sums["sw"] for c in names] for a in names])
        covariance = np.array([(sums[f"y_{a}"] - centre * sums[f"s_{a}"]) / sums["sw"] for a in names])
        b = np.linalg.solve(gram + l2 * np.eye(len(names)), covariance)
        fitted = F.lit(float(centre))
        for value, name in zip(b, names):
            fitted = fitted + F.lit(float(value)) * F.col(name)
        residual = F.abs(F.col("target") - fitted)
        median = exact_quantiles(frame.select(F.lit(1).alias("g"), residual.alias("r")), ["g"], "r", {"m": 0.5}).first()["m"]
        if median * MAD_TO_SIGMA <= 1e-12:
            break
        cutoff = F.lit(delta * median * MAD_TO_SIGMA)
        fresh = F.when(residual <= cutoff, 1.0).otherwise(cutoff / residual)
        change = frame.agg(F.max(F.abs(fresh - robust)).alias("change")).first()["change"]
        robust = fresh
        if change < 1e-6:  # of the largest weight change
            break
    return Moments(base.total, base.means, base.scales, float(centre), base.gram, base.covariance), b


def fit_stumps(rows: DataFrame, features: Sequence[str], rounds: int, rate: float) -> list[tuple[str, int, float, float]]:
    """Boosted depth-one splits on ten equal bins of [0, 1] (MDL18).

    Residuals stay a projection over the fixed bins; a round is one aggregation to
    features x bins sums. No stride sample is needed.
    """
    bins = [F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col(f) * 10))).cast("int").alias(f"_b{i}") for i, f in enumerate(features)]
    frame = cut_lineage(rows.select(*bins, "target"))
    mean = frame.agg(F.avg("target")).first()[0]
    fitted, stumps = F.lit(float(mean)), []
    for _ in range(rounds):
        cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"_b{i}").alias("bin")) for i in range(len(features))])
        table = frame.select((F.col("target") - fitted).alias("r"), F.explode(cells).alias("x")).groupBy("x.feature", "x.bin").agg(
            F.sum("r").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        sums, counts = np.zeros((len(features), 10)), np.zeros((len(features), 10))
        for cell in table:
            sums[cell["feature"], cell["bin"]], counts[cell["feature"], cell["bin"]] = cell["s"], cell["n"]
        left_sum, left_n = np.cumsum(sums, axis=1)[:, :9], np.cumsum(counts, axis=1)[:, :9]
        right_sum, right_n = sums.sum(axis=1, keepdims=True) - left_sum, counts.sum(axis=1, keepdims=True) - left_n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((left_n > 0) & (right_n > 0), left_sum**2 / left_n + right_sum**2 / right_n, -np.inf)
        best = int(np.argmax(gain))  # first maximum: lowest feature, then lowest bin
        i, split = divmod(best, 9)
        if not np.isfinite(gain[i, split]):
            break
        left, right = rate * left_sum[i, split] / left_n[i, split], rate * right_sum[i, split] / right_n[i, split]
        stumps.append((features[i], split, float(left), float(right)))
        fitted = fitted + F.when(F.col(f"_b{i}") <= split, float(left)).otherwise(float(right))
    return stumps


def extreme_pairs(rows: DataFrame, features: Sequence[str], count: int, *, mirrored: bool = False) -> DataFrame:
    """High/low pairs per formation by (target, id): the i-th from each end, or 64 spread mirrored ones (MDL19, MDL20).

    Places come from the distributed position; a formation contributes at most ``count`` pairs.
    """
    placed = with_position(rows, ["formation_date"], "target", "security_id", position="_p", size="_n").withColumn(
        "_c", F.least(F.lit(count), F.floor(F.col("_n") / 2)))
    if mirrored:
        half = F.floor(F.col("_n") / 2)
        steps = placed.where("_p = 1 AND _c > 0").select("formation_date", "_n", "_c", F.explode(F.sequence(F.lit(0), (F.col("_c") - 1).cast("int"))).alias("pair"))
        plan = steps.select("formation_date", "pair", "_n", "_c", F.least(half - 1, F.floor(F.col("pair") * half / F.col("_c"))).alias("_low"))
        low = placed.select("formation_date", (F.col("_p") - 1).alias("_low"), *[F.col(f).alias(f"lo_{f}") for f in features])
        high = placed.select("formation_date", (F.col("_n") - F.col("_p")).alias("_low"), *[F.col(f).alias(f"hi_{f}") for f in features])
        pairs = plan.join(low, ["formation_date", "_low"]).join(high, ["formation_date", "_low"])
    else:
        low = placed.where("_p <= _c").select("formation_date", "_c", F.col("_p").alias("pair"), *[F.col(f).alias(f"lo_{f}") for f in features])
        high = placed.where("_n - _p < _c").select("formation_date", (F.col("_n") - F.col("_p") + 1).alias("pair"), *[F.col(f).alias(f"hi_{f}") for f in features])
        pairs = low.join(high, ["formation_date", "pair"])
    return pairs.select("formation_date", "pair", F.col("_c").alias("pairs"), *[(F.col(f"hi_{f}") - F.col(f"lo_{f}")).alias(f) for f in features])


def fit_pairwise(rows: DataFrame, features: Sequence[str], penalty: float, *, mirrored: bool, steps: int = 50) -> tuple[Moments, np.ndarray]:
    """Logistic fit on standardised pair differences by Newton steps, one aggregation each (MDL19, MDL20).

    MDL19's order-dependent stochastic steps are replaced by the full-batch optimum of the same loss.
    """
    base = next(iter(moments(month_balanced(rows), features, weight="weight").values()))
    pairs = extreme_pairs(rows, features, PAIRS_PER_FORMATION if mirrored else 10, mirrored=mirrored)
    z = [(F.col(f) / float(base.scales[i])).alias(f"z{i}") for i, f in enumerate(features)]
    names = [f"z{i}" for i in range(len(features))]
    months = rows.select("formation_date").distinct().withColumn("_m", F.date_trunc("month", "formation_date"))
    per_month = months.groupBy("_m").agg(F.count(F.lit(1)).alias("_f"))
    weights = months.join(per_month, "_m").select("formation_date", "_f")
    frame = pairs.join(weights, "formation_date").select(*z, (1.0 / F.col("_f") / F.col("pairs")).alias("w"))
    if mirrored:
        norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))
        frame = frame.withColumn("_norm", norm).where("_norm > 1e-12").select(*[(F.col(n) / F.col("_norm")).alias(n) for n in names], "w")
    frame, b = cut_lineage(frame), np.zeros(len(features))
    for _ in range(steps):
        margin = F.lit(0.0)
        for value, name in zip(b, names):
            margin = margin + F.lit(float(value)) * F.col(name)
        miss = 1.0 / (1.0 + F.exp(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), margin))))
        sums = frame.withColumn("e", miss).agg(
            *[F.sum(F.col("w") * F.col("e") * F.col(a)).alias(f"g_{a}") for a in names],
            *[F.sum(F.col("w") * F.col("e") * (1 - F.col("e")) * F.col(a) * F.col(c)).alias(f"h_{a}_{c}") for i, a in enumerate(names) for c in names[i:]]).first()
        gradient = penalty * b - np.array([sums[f"g_{a}"] for a in names])
        hessian = np.array([[sums[f"h_{min(a, c)}_{max(a, c)}"] for c in names] for a in names]) + penalty * np.eye(len(names))
        step = np.linalg.solve(hessian, gradient)
        b = b - step
        if np.max(np.abs(step)) < 1e-9:
            return base, b
    raise RuntimeError(f"the pairwise fit did not converge in {steps} steps")


def recalibrate(rows: DataFrame, features: Sequence[str], base: Moments, b: np.ndarray) -> tuple[Moments, np.ndarray]:
    """Scale pair coefficients to the target by a regression of target on raw score (MDL19)."""
    flat = Moments(base.total, base.means, base.scales, 0.0, base.gram, base.covariance)
    line = rows.select("target", prediction(features, flat, b).alias("s")).agg(
        F.regr_slope("target", "s").alias("slope"), F.regr_intercept("target", "s").alias("intercept"), F.avg("target").alias("mean")).first()
    slope = line["slope"] or 0.0
    centre = line["intercept"] if line["slope"] is not None else line["mean"]
    return Moments(base.total, base.means, base.scales, float(centre), base.gram, base.covariance), b * slope


def fold_rows(rows: DataFrame, roles: DataFrame, role: str, keys: Sequence[str] = ("outer_fold",)) -> DataFrame:
    """Examples of one role per fold; the role table is bounded by dates x folds."""
    return rows.join(roles.where(F.col("role") == role).select(*keys, "formation_date"), "formation_date")


def out_of_fold(rows: DataFrame, roles: DataFrame, features: Sequence[str], l1: float, l2: float, weight: str | None = None) -> DataFrame:
    """Fit per fold on its training rows, score its validation rows (MDL25)."""
    found = moments(fold_rows(rows, roles, "train"), features, weight=weight, keys=["outer_fold"])
    valid, scored = fold_rows(rows, roles, "validation"), None
    chosen = None
    for (fold,), m in sorted(found.items()):
        value = prediction(features, m, solve(m, l1, l2))
        chosen = F.when(F.col("outer_fold") == fold, value) if chosen is None else chosen.when(F.col("outer_fold") == fold, value)
    scored = valid.withColumn("prediction", chosen if chosen is not None else F.lit(None).cast("double"))
    return scored.where("prediction IS NOT NULL").select("outer_fold", "formation_date", "security_id", "prediction", "target")


def grid_search(rows: DataFrame, roles: DataFrame, features: Sequence[str], grid: Sequence[tuple[float, float]], keys: Sequence[str] = ("outer_fold",)) -> DataFrame:
    """Validation RMSE of every penalty pair: two aggregations in all (MDL24).

    The squared error of a linear model is a quadratic form of the validation moments, so no
    grid point ever re-reads the data.
    """
    train = moments(fold_rows(rows, roles, "train", keys), features, keys=keys)
    target_var = {
        tuple(r[k] for k in keys): r["v"]
        for r in fold_rows(rows, roles, "validation", keys).groupBy(*keys).agg(F.var_pop("target").alias("v")).collect()}
    valid = moments(fold_rows(rows, roles, "validation", keys), features, keys=keys)
    scored = []
    for l1, l2 in grid:
        for key, m in train.items():
            if key not in valid:
                continue
            v, b = valid[key], solve(m, l1, l2)
            beta = b / m.scales
            bias = v.target_mean - m.target_mean - float(beta @ (v.means - m.means))
            cov = v.covariance * v.scales
            second = v.gram * np.outer(v.scales, v.scales)
            mse = target_var[key] - 2 * float(beta @ cov) + float(beta @ second @ beta) + bias**2
            scored.append((*[int(k) for k in key], float(l1), float(l2), float(max(mse, 0.0) ** 0.5)))
    return rows.sparkSession.createDataFrame(scored, ", ".join(f"{k} int" for k in keys) + ", l1 double, l2 double, rmse double")


def select_penalty(scores: DataFrame, keys: Sequence[str] = ("outer_fold",), tolerance: float = 0.0) -> DataFrame:
    """Lowest mean RMSE per key; within the tolerance the stronger penalty wins (MDL24)."""
    mean = scores.groupBy(*keys, "l1", "l2").agg(F.avg("rmse").alias("rmse"))
    best = mean.groupBy(*keys).agg(F.min("rmse").alias("_best"))
    near = mean.join(best, list(keys)).where(F.col("rmse") <= F.col("_best") + tolerance)
    return near.groupBy(*keys).agg(F.max(F.struct(F.col("l1") + F.col("l2"), "l1", "l2", "rmse")).alias("x")).select(*keys, "x.l1", "x.l2", "x.rmse")


def drift_check(fitted: DataFrame, frozen: DataFrame, tolerance: float) -> DataFrame:
    """Refit coefficients against frozen ones (MDL30)."""
    old = frozen.select("feature_key", F.col("coefficient").alias("frozen"))
    return fitted.join(old, "feature_key", "full").select(
        "feature_key", "coefficient", "frozen", F.coalesce(F.abs(F.col("coefficient") - F.col("frozen")) <= tolerance, F.lit(False)).alias("matches"))


def basket_calibration(rows: DataFrame, size: int = 20) -> DataFrame:
    """Monthly top basket: mean prediction against mean outcome, regression and residual quantiles (MDL31)."""
    newest = Window.partitionBy("formation_date").orderBy(F.col("prediction").desc(), "security_id")
    baskets = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= size).groupBy("formation_date").agg(
        F.avg("prediction").alias("p"), F.avg("target").alias("a"))
    fitted = baskets.agg(F.count(F.lit(1)).alias("baskets"), F.regr_slope("a", "p").alias("slope"), F.regr_intercept("a", "p").alias("intercept"),
                         F.avg(F.col("a") - F.col("p")).alias("bias")).withColumn("g", F.lit(1))
    residuals = exact_quantiles(baskets.select(F.lit(1).alias("g"), (F.col("a") - F.col("p")).alias("e")), ["g"], "e", {"low_residual": 0.1, "high_residual": 0.9})
    return fitted.join(residuals, "g").drop("g")
