"""Read-model queries over published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import latest_per_key
from .joins import listing_on

LOCAL_ZONE = "America/Toronto"


def dated_scores(scores: DataFrame, runs: DataFrame, listings: DataFrame, deployments: DataFrame, day: Column, ids: Sequence[int] | None = None) -> DataFrame:
    """Scores of the newest deployed model for one completed date, with the ticker of that date (SRV01)."""
    model = deployments.orderBy(F.col("deployed_at").desc()).limit(1).select("model_version")
    rows = scores.where(F.col("score_date") == day)
    if ids:
        rows = rows.where(F.col("security_id").isin(*ids))
    done = runs.where("status = 'completed'").select("score_date")
    rows = rows.join(done, "score_date", "left_semi").join(model, "model_version", "left_semi")
    named = listing_on(rows.select("security_id", "score_date"), listings, "score_date").select("security_id", "ticker")
    return rows.join(named, "security_id", "left").orderBy(F.col("eligible").desc(), F.col("score_rank").asc_nulls_last(), "security_id")


def score_history(scores: DataFrame, security_id: int, through: Column, limit: int) -> DataFrame:
    """Last ``limit`` eligible scores, ascending (SRV02)."""
    kept = scores.where((F.col("security_id") == security_id) & F.col("eligible") & (F.col("score_date") <= through))
    return kept.orderBy(F.col("score_date").desc()).limit(limit).orderBy("score_date")


def scores_before(scores: DataFrame, runs: DataFrame, day: Column) -> DataFrame:
    """Scores of the latest completed earlier date (SRV03)."""
    done = runs.where((F.col("status") == "completed") & (F.col("score_date") < day)).join(scores.select("score_date"), "score_date", "left_semi")
    return scores.join(done.agg(F.max("score_date").alias("score_date")), "score_date", "left_semi")


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.where("status = 'completed'").orderBy(F.col("score_date").desc()).limit(limit)


def filings_since(filings: DataFrame, runs: DataFrame, day: Column) -> DataFrame:
    """Filings accepted on local dates after the previous completed run, up to the day (SRV05)."""
    local = F.to_date(F.from_utc_timestamp("accepted_at", LOCAL_ZONE))
    previous = runs.where((F.col("status") == "completed") & (F.col("score_date") < day)).agg(F.max("score_date").alias("previous"))
    rows = filings.withColumn("local_date", local).where(F.col("local_date") <= day)
    later = rows.crossJoin(F.broadcast(previous)).where(F.col("local_date") > F.col("previous"))
    return later.groupBy("form").agg(F.count(F.lit(1)).alias("filings"), F.count_distinct("security_id").alias("companies"))


def operations_history(events: DataFrame, warning: str, resolution: str) -> DataFrame:
    """Per run: last event, counts by kind and warnings after the last resolution (SRV06).

    One conditional aggregation finds the last resolution; the warnings after it are a second
    one. No per-run event list is built.
    """
    resolved = events.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == resolution, F.col("event_id"))), F.lit(-1)).alias("_resolved"))
    rows = events.join(resolved, "run_id")
    return rows.groupBy("run_id").agg(
        F.max_by("event_type", "event_id").alias("last_event_type"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == warning).alias("warnings"),
        F.count_if((F.col("event_type") == warning) & (F.col("event_id") > F.col("_resolved"))).alias("unresolved_warnings"))


def price_history(bars: DataFrame, security_id: int, limit: int) -> DataFrame:
    """Last ``limit`` closes, ascending (SRV07)."""
    kept = bars.where(F.col("security_id") == security_id).select("session_date", "close")
    return kept.orderBy(F.col("session_date").desc()).limit(limit).orderBy("session_date")


def search(securities: DataFrame, listings: DataFrame, term: str, limit: int = 12) -> DataFrame:
    """Case-insensitive contains on ticker or name, ticker prefixes first (SRV08)."""
    current = latest_per_key(listings.where(F.col("valid_to").isNull()), ["security_id"], ["valid_from"]).select("security_id", "ticker")
    text = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    rows = securities.join(current, "security_id").where(F.col("ticker").ilike(f"%{text}%") | F.col("issuer_name").ilike(f"%{text}%"))
    first = F.when(F.col("ticker").ilike(f"{text}%"), 0).otherwise(1)
    return rows.orderBy(first, "ticker").limit(limit).select("security_id", "issuer_name", "ticker")


def explanations(contributions: DataFrame, registry: DataFrame, security_id: int, day: Column) -> DataFrame:
    """Contributions of one snapshot with the definition, largest first, nulls last (SRV09)."""
    rows = contributions.where((F.col("security_id") == security_id) & (F.col("formation_date") == day))
    named = rows.withColumn("input_key", F.regexp_replace("feature_key", "_percentile$", ""))
    return named.join(registry.select(F.col("feature_key").alias("input_key"), "feature_version", "direction"), "input_key").orderBy(
        F.col("contribution").desc_nulls_last())


def latest_deployment(deployments: DataFrame) -> DataFrame:
    """Newest deployment of each model family (SRV10)."""
    return deployments.groupBy("model_family").agg(F.max("deployed_at").alias("deployed_at"), F.max_by("model_version", "deployed_at").alias("model_version"))


def sorted_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with critical ones first (SRV11)."""
    severity = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return alerts.withColumn("severity_order", severity).orderBy("severity_order", "code", "metric")


def distinct_inputs(*frames: DataFrame) -> DataFrame:
    """Distinct union of source ids over several inputs (SET02)."""
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame)
    return united.distinct()


def complete_sets(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Keys holding exactly ``size`` rows (SET08)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") == size)


def nth_session(sessions: DataFrame, n: int) -> DataFrame:
    """The n-th later session of every session, set-wise instead of OFFSET n LIMIT 1 (SET06)."""
    later = sessions.select((F.col("idx") - n).alias("idx"), F.col("session_date").alias("nth_session"))
    return sessions.select("session_date", "idx").join(later, "idx").drop("idx")


def latest_row(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """DISTINCT ON (keys) ... ORDER BY order DESC (SET04)."""
    return latest_per_key(rows, keys, order)


def score_changes(scores: DataFrame) -> DataFrame:
    own = Window.partitionBy("security_id").orderBy("score_date")
    return scores.withColumn("change", F.col("score") - F.lag("score").over(own))
