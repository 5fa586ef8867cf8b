"""Exact ranks, positions and quantiles that never sort a whole group in one task.

A plain ``rank() over (partition by group order by value)`` puts every row of a
group on one task. Here a group is split into ordered buckets, and only the bucket
totals (a few thousand rows per group at most) are prefix-summed over the group. The
result is exact whatever the bucket sizes are: the bucket is a monotone function
of the value, so it changes balance and never the answer. Positions and quantiles
collapse equal values map-side first; tie ranks move the rows themselves, once, by
group and bucket, so that the rows of a bucket, or all nulls, of a group meet in one task.

Group keys must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 1024
SMALLEST_STEP = 2.0**20
#: Beyond every bucket of a finite number, for infinities and NaN, which Spark orders last.
LAST_BUCKET = 2**22


def order_bucket(value: Column) -> Column:
    """Monotone coarse key of a number: linear near zero, 1024 steps per power of two, NaN last.

    Values around 100 that differ by 2 % fall in about thirty buckets, ids of one million to two million in
    a thousand; a group has at most some ten thousand. Never null, so that Spark adds no null
    filter and both uses of it share one exchange.
    """
    number = value.cast("double")
    octave = F.log2(F.lit(1.0) + F.abs(number) * F.lit(SMALLEST_STEP))
    step = F.signum(number) * octave * F.lit(float(STEPS_PER_OCTAVE))
    bounded = F.least(F.greatest(step, F.lit(-float(LAST_BUCKET))), F.lit(float(LAST_BUCKET)))
    return F.when(F.isnan(number), F.lit(LAST_BUCKET + 1)).otherwise(F.coalesce(F.floor(bounded), F.lit(0)))


def bucket_offsets(weights: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """(keys, _bucket, _before, total) of the ``_weight`` of each bucket: what lies in lower buckets, and in the group."""
    group = Window.partitionBy(*keys)
    lower = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return weights.select(
        *keys, "_bucket", F.coalesce(F.sum("_weight").over(lower), F.lit(0)).alias("_before"), F.sum("_weight").over(group).alias(total))


def cumulative_below(
    counts: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, weight: str, *,
    below: str = "below", total: str = "total",
) -> DataFrame:
    """Add the weight strictly below each row in ``order`` and the group's total weight.

    ``(keys, order)`` is unique in ``counts`` and ``bucket`` is monotone in ``order``.
    """
    keys = list(keys)
    bucketed = counts.select("*", bucket.alias("_bucket"))
    before = (Window.unboundedPreceding, -1)
    offsets = bucket_offsets(bucketed.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_weight")), keys, total)
    inside = F.sum(weight).over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(*before))
    placed = bucketed.select("*", F.coalesce(inside, F.lit(0)).alias("_inside")).join(offsets, [*keys, "_bucket"])
    kept = [c for c in counts.columns]
    return placed.select(*kept, (F.col("_before") + F.col("_inside")).alias(below), total)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, *, ties: str = "ties") -> DataFrame:
    """One row per distinct non-null value of each group; hot values collapse before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(ties))


def with_tie_ranks(df: DataFrame, keys: Sequence[str], value: str, *, source: DataFrame | None = None, pieces: int | None = None) -> DataFrame:
    """Add ``below`` (rows with a smaller value), ``ties`` and ``total`` (non-null rows of the group).

    Rows without a value keep their group's ``total``, with null ``below`` and ``ties``. ``source`` has the same
    keys and values where ``df`` is costly to compute twice: the buckets are counted from it. ``pieces`` is the number of
    tasks that rows are dealt to where the shuffle's own number would leave too many for one.
    """
    keys = list(keys)
    # Nulls have a bucket of their own, without weight: the last one.
    bucket = F.when(F.col(value).isNull(), F.lit(2**62)).otherwise(order_bucket(F.col(value)))
    rows = df.select("*", bucket.alias("_bucket"))
    dealt = (lambda frame: frame.repartition(pieces, *keys, "_bucket")) if pieces else (lambda frame: frame)
    counted = rows if source is None else source.select(*keys, value, bucket.alias("_bucket"))
    offsets = bucket_offsets(counted.groupBy(*keys, "_bucket").agg(F.count(value).alias("_weight")), keys, "total")
    # One shuffle and one sort of the rows: within a bucket both counts are running ones, the second with all equals of the row.
    within = Window.partitionBy(*keys, "_bucket").orderBy(value)
    placed = dealt(rows).select("*", (F.rank().over(within) - 1).alias("_less"), F.count(value).over(within).alias("_upto"))
    known = F.col(value).isNotNull()
    return placed.join(dealt(offsets), [*keys, "_bucket"]).select(
        *df.columns, F.when(known, F.col("_before") + F.col("_less")).alias("below"),
        F.when(known, F.col("_upto") - F.col("_less")).alias("ties"), "total")


def tie_percentile() -> Column:
    """Average tie position over n-1, from the columns of :func:`with_tie_ranks`."""
    mid = (F.col("below") + F.col("below") + F.col("ties") - 1) / F.lit(2.0)
    return F.when(F.col("total") > 1, mid / (F.col("total") - 1))


def average_rank() -> Column:
    """One-based rank averaged over ties (the Spearman rank)."""
    return F.col("below") + (F.col("ties") + 1) / F.lit(2.0)


def with_position(
    df: DataFrame, keys: Sequence[str], value: str, tie_break: str, *,
    descending: bool = False, position: str = "position", size: str = "group_size",
) -> DataFrame:
    """Add the one-based place of each row by (value, tie_break) and the group size.

    ``tie_break`` is numeric and unique within the group; the value must not be null.
    """
    keys = list(keys)
    signed = F.col(value) * (-1 if descending else 1)
    rows = df.select("*", signed.alias("_sort"), order_bucket(F.col(tie_break)).alias("_tie"))
    counts = rows.groupBy(*keys, "_sort", "_tie").agg(F.count(F.lit(1)).alias("_rows"))
    ranked = cumulative_below(counts, keys, ["_sort", "_tie"], order_bucket(F.col("_sort")), "_rows", below="_below", total=size)
    place = F.row_number().over(Window.partitionBy(*keys, "_sort", "_tie").orderBy(tie_break))
    return rows.join(ranked, [*keys, "_sort", "_tie"]).select(
        *df.columns, (F.col("_below") + place).cast("long").alias(position), F.col(size).cast("long").alias(size))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    ranked = cumulative_below(value_counts(df, keys, value), keys, [value], order_bucket(F.col(value)), "ties")
    outputs = []
    for name, probability in probabilities.items():
        place = (F.col("total") - 1) * F.lit(float(probability))
        covers = lambda index: (F.col("below") <= index) & (index < F.col("below") + F.col("ties"))
        low, high = F.floor(place), F.ceil(place)
        lower = F.max(F.when(covers(low), F.col(value)))
        upper = F.max(F.when(covers(high), F.col(value)))
        outputs.append((lower + (upper - lower) * F.max(place - low)).cast("double").alias(name))
    return ranked.groupBy(*keys).agg(*outputs)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, *, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per group. Spark prunes each map task to ``limit`` rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)
