"""Point-in-time selection: latest version per key and first usable decision per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import top_rows


def best_first(order: Sequence[str | Column]) -> list[Column]:
    """Sort keys for "larger is better" columns, nulls last."""
    return [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Row with the largest ``order`` per key.

    The ``row_number() = 1`` filter is pruned map-side, so a hot key is cut to one row per task.
    """
    return top_rows(df, keys, best_first(order), 1, rank="_latest").drop("_latest")


def decision_intervals(decisions: DataFrame) -> DataFrame:
    """One row per calendar day of the half-open interval (previous decision, decision].

    ``decisions`` has ``formation_date`` and ``decision_at``, one row per session, so the
    result is bounded by the number of calendar days and serves as an equi-join side. The first
    interval is open to the left: its ``previous_at`` is null, and it has only its own day, to which
    earlier rows are moved.
    """
    ordered = Window.partitionBy(F.lit(1)).orderBy("decision_at")
    return (
        decisions.select("formation_date", "decision_at")
        .withColumn("decision_ord", F.row_number().over(ordered))
        .withColumn("_end_ord", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) + 1)
        .withColumn("previous_at", F.lag("decision_at").over(ordered))
        .withColumn("_day", F.explode(F.sequence(F.to_date(F.coalesce("previous_at", "decision_at")), F.to_date("decision_at"))))
    )


def with_first_decision(df: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """Attach the earliest decision at or after ``at``; rows after the last decision drop out.

    An equi join on the day with a range residual: every row meets at most two candidates,
    so the cost does not grow with formations x rows.
    """
    days = decision_intervals(decisions)
    first = decisions.agg(F.to_date(F.min("decision_at")).alias("_first"))  # one row
    return (
        df.crossJoin(F.broadcast(first)).withColumn("_day", F.greatest(F.to_date(at), "_first"))
        .join(days, "_day")
        .where((F.col("previous_at").isNull() | (F.col(at) > F.col("previous_at"))) & (F.col(at) <= F.col("decision_at")) & F.col(at).isNotNull())
        .drop("_day", "_first", "previous_at")
    )


def version_intervals(versions: DataFrame, keys: Sequence[str], decisions: DataFrame, at: str, order: Sequence[str]) -> DataFrame:
    """Best version per key with the decision range [decision_ord, until_ord) over which it holds.

    Versions are first cut to one per (key, decision), so the per-key windows hold at most
    one row per decision. A late version that ranks below an earlier one never takes over.
    """
    bounded = latest_per_key(with_first_decision(versions, decisions, at), [*keys, "decision_ord"], order)
    by_key = Window.partitionBy(*keys).orderBy("decision_ord")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, -1)
    standing = F.struct(*order)
    kept = bounded.withColumn("_best", F.max(standing).over(so_far)).where(F.col("_best").isNull() | (standing > F.col("_best")))
    until = F.coalesce(F.lead("decision_ord").over(by_key), F.col("_end_ord"))
    return kept.withColumn("until_ord", until).drop("_end_ord", "_best")


def expand_versions(intervals: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per key and decision from :func:`version_intervals` (the size of the answer itself)."""
    ordered = Window.partitionBy(F.lit(1)).orderBy("decision_at")
    numbered = decisions.select("formation_date", "decision_at").withColumn("decision_ord", F.row_number().over(ordered))
    span = F.explode(F.sequence(F.col("decision_ord"), F.col("until_ord") - 1))
    return (
        intervals.drop("formation_date", "decision_at").withColumn("decision_ord", span)
        .drop("until_ord").join(numbered, "decision_ord").drop("decision_ord")
    )
