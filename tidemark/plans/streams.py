"""STR: Structured Streaming twins, run to the end of their input and compared with the batch result."""

from pyspark.sql import functions as F

from ..functions.scalars import observed_available_at
from ..fixtures import Research
from ..sources.sinks import observation_hash
from ..streaming import logs
from . import query
from .joins import OBSERVED
from .labels import FORWARD, snapshots

HASHED = ["event_id", "security_id", "concept", "period_end", "value", "observed_at"]


def streamed(r, table: str) -> Research:
    """The same fixture views over a streaming scan of one driver table."""
    twin = Research(r.spark, r.sf_dir)
    source = logs.file_stream(r.spark, r.sf_dir, r.table(table).schema, f"{table}.parquet")
    twin.table = lambda name: source if name == table else Research.table(twin, name)
    return twin


def observations(r):
    rows = streamed(r, "events").observations.withColumn("observation_hash", observation_hash(*HASHED))
    return rows.withColumn("available_at", observed_available_at(F.col("accepted_at"), F.col("observed_at")))


@query("STR01_deduplicated_observations", "SELECT DISTINCT event_id, security_id, concept, period_end, value FROM observations", digits="value")
def _(r):
    root = logs.work_dir(r.spark, "dedupe")
    logs.run_to_end(logs.deduplicated(observations(r)), f"{root}/checkpoint", sink=f"{root}/rows")
    return r.spark.read.parquet(f"{root}/rows").select("event_id", "security_id", "concept", "period_end", "value")


@query("STR01_watermarked_observations", "SELECT DISTINCT event_id, security_id, concept, period_end, value FROM observations", digits="value")
def _(r):
    """The bounded form: a key leaves the state once the watermark has passed it."""
    root = logs.work_dir(r.spark, "dedupe")
    logs.run_to_end(logs.deduplicated(observations(r), event_time="observed_at", horizon="1 day"), f"{root}/checkpoint", sink=f"{root}/rows")
    return r.spark.read.parquet(f"{root}/rows").select("event_id", "security_id", "concept", "period_end", "value")


@query("STR02_latest_fact_state", f"""
    SELECT security_id, concept, period_end, value, lineage_key FROM observations
    QUALIFY row_number() OVER (PARTITION BY security_id, concept, period_end ORDER BY {OBSERVED} DESC, observed_at DESC, lineage_key DESC) = 1""", digits="value")
def _(r):
    root, keys = logs.work_dir(r.spark, "latest"), ["security_id", "concept", "period_end"]
    state = logs.latest_state(observations(r), keys, ["available_at", "observed_at", "lineage_key"], ["value"])
    logs.run_to_end(state, f"{root}/checkpoint", batch=logs.write_updates(f"{root}/rows"), mode="update")
    return logs.read_updates(r.spark, f"{root}/rows", keys).select(*keys, "latest.value", "latest.lineage_key")


@query("STR03_closed_decisions", f"""
    SELECT d.formation_date, count(*) AS observations, count(DISTINCT o.event_id) AS events FROM (SELECT *, {OBSERVED} AS available_at FROM observations) o
    JOIN (SELECT *, coalesce(lag(decision_at) OVER (ORDER BY decision_at), TIMESTAMP '-infinity') AS prev FROM observation_decisions) d ON available_at > prev AND available_at <= decision_at GROUP BY 1""")
def _(r):
    root = logs.work_dir(r.spark, "decisions")
    rows = observations(r).select("event_id", "security_id", "available_at", "observed_at")
    logs.run_to_end(rows, f"{root}/checkpoint", batch=logs.close_decisions(f"{root}/rows", r.observation_decisions, "available_at", "observed_at"))
    return r.spark.read.parquet(f"{root}/rows").groupBy("formation_date").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("event_id").alias("events"))


@query("STR04_due_labels", FORWARD, digits="relative_return")
def _(r):
    root = logs.work_dir(r.spark, "labels")
    days = streamed(r, "lineitem").trades.select("session_date")
    emit = logs.emit_due_labels(f"{root}/rows", f"{root}/calendar", snapshots(r), r.bars, r.benchmark_bars, [5, 20, 60])
    logs.run_to_end(days, f"{root}/checkpoint", batch=emit)
    return r.spark.read.parquet(f"{root}/rows").drop("batch_id", "cutoff_at")
