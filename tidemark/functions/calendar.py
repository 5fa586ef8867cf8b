"""Trading-calendar helpers. Their frames are bounded by the number of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_next_session(df: DataFrame, sessions: DataFrame, day: str, *, on_or_after: bool = False) -> DataFrame:
    """Add the first session after ``day`` (or on it) as ``following_session``.

    Every day before the calendar maps to its first session; rows after the last session drop out.
    """
    first = sessions.agg(F.date_sub(F.min("session_date"), 1).alias("_first"))  # one row
    asked = F.date_sub(day, 1) if on_or_after else F.col(day)
    placed = df.crossJoin(F.broadcast(first)).withColumn("_day", F.when(F.col(day).isNotNull(), F.greatest(asked, "_first")))
    return placed.join(next_session_map(sessions).withColumnRenamed("day", "_day"), "_day").drop("_day", "_first")


def next_session_map(sessions: DataFrame) -> DataFrame:
    """calendar ``day`` -> first session strictly after it, from the day before the first session on."""
    ordered = Window.partitionBy(F.lit(1)).orderBy("session_date")
    return (
        sessions.select("session_date")
        .withColumn("_from", F.coalesce(F.lag("session_date").over(ordered), F.date_sub("session_date", 1)))
        .withColumn("day", F.explode(F.sequence("_from", F.date_sub("session_date", 1))))
        .select("day", F.col("session_date").alias("following_session"))
    )


def forward_sessions(sessions: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Each session with the sessions at the given forward offsets."""
    ordered = Window.partitionBy(F.lit(1)).orderBy("session_date")
    return sessions.select(
        F.col("session_date").alias("formation_date"),
        *[F.lead("session_date", n).over(ordered).alias(name) for name, n in offsets.items()],
    )


def label_windows(sessions: DataFrame, formations: DataFrame, horizon: int = 20) -> DataFrame:
    """Entry at the next session, outcome ``horizon`` sessions after entry, complete windows only."""
    ahead = forward_sessions(sessions, {"entry_date": 1, "outcome_date": horizon + 1})
    return formations.select("formation_date").join(ahead, "formation_date").where(F.col("outcome_date").isNotNull())


def window_sessions(sessions: DataFrame, windows: DataFrame, horizon: int = 20) -> DataFrame:
    """One row per window and session on its path (horizon + 1 rows per window)."""
    index = sessions.select("session_date", "idx")
    anchored = windows.join(index.withColumnsRenamed({"session_date": "entry_date", "idx": "_entry"}), "entry_date")
    steps = anchored.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon)))).withColumn("idx", F.col("_entry") + F.col("step"))
    return steps.join(index, "idx").drop("_entry", "idx")
