"""Streaming twins of the append-only logs.

Each job equals its batch twin once its input is exhausted. Batch writes are keyed by the
batch id, or guarded by an anti join, so a batch that is replayed after a failure adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.asof import latest_per_key, with_first_decision
from ..operators.labels import forward_windows, returns_over
from ..session import cut_lineage, shared_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{shared_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is given, never inferred."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def deduplicated(stream: DataFrame, key: str = "observation_hash", event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """Each observation once by content hash (STR01).

    With a horizon the state is bounded by the watermark; without one it keeps every key, as the
    reference log does.
    """
    if event_time and horizon:
        return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def latest_state(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Running latest version per fact key, for update mode (STR02); batch twin: latest per key."""
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *payload)).alias("latest"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows already on storage, or an empty frame of the same shape."""
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else like.limit(0)


def write_updates(path: str) -> Callable[[DataFrame, int], None]:
    """Update-mode sink: one folder per batch id, replaced when the batch is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest update per key."""
    return latest_per_key(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def close_decisions(path: str, decisions: DataFrame, at: str, seen: str, lateness: str = "1 day") -> Callable[[DataFrame, int], None]:
    """Late-data rule (STR03): rows join the first open decision they are available for.

    A decision closes once the watermark, the largest ``seen`` of earlier batches less ``lateness``,
    has passed it. Until then batches append to it; a row that arrives for a closed decision goes to
    the next open one. Rows of a closed decision never change, and no row is dropped before the last
    decision. The watermark is read from batches before this one, so a replay gives the same rows.
    """
    marks = f"{path}-marks"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = batch.agg(F.max(seen).alias("mark"))
        passed = stored(spark, marks, mark.withColumn("batch", F.lit(0).cast("long"))).where(F.col("batch") < batch_id)
        passed = passed.agg((F.max("mark") - F.expr(f"INTERVAL {lateness}")).alias("_passed"))
        # one row; nothing is closed before the first batch
        open_at = batch.crossJoin(F.broadcast(passed)).withColumn(
            "_open", F.greatest(F.col(at), F.col("_passed") + F.expr("INTERVAL 1 MICROSECOND")))
        rows = with_first_decision(open_at, decisions, "_open").select(*batch.columns, "formation_date").withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        mark.write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
    return write


def between_dates(rows: DataFrame, column: str, low, high) -> DataFrame:
    """Rows of a range of dates, as literals that reach the scan."""
    return rows.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))


def emit_due_labels(path: str, calendar: str, snapshots: DataFrame, bars: DataFrame, benchmark: DataFrame, horizons: Sequence[int]) -> Callable[[DataFrame, int], None]:
    """A label is emitted once its h-th later session exists, and only once (STR04).

    ``batch`` carries new session dates. The state is the calendar, a date for each session and the batch that brought
    it; the windows that close in a batch are those of its calendar less those of the calendar before, so only their
    snapshots and the bars of their dates are read, however long the history. Sessions may arrive in
    any order: one that arrives late closes the windows that it completes, and labels of earlier batches stay. A batch
    that is replayed gives the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("session_date").distinct()
        new.write.mode("overwrite").parquet(f"{calendar}/batch={batch_id}")
        known = spark.read.parquet(calendar).where(F.col("batch") <= batch_id).groupBy("session_date").agg(F.min("batch").alias("batch"))
        ordered = Window.partitionBy(F.lit(1)).orderBy("session_date")
        at = lambda through: known.where(F.col("batch") <= through).withColumn("idx", F.row_number().over(ordered))
        closed = forward_windows(at(batch_id - 1), horizons).select("score_date", "horizon")
        due = cut_lineage(forward_windows(at(batch_id), horizons).join(closed, ["score_date", "horizon"], "left_anti"))
        span = due.agg(F.min("score_date").alias("first"), F.max("score_date").alias("last"), F.min("entry").alias("entry"), F.max("exit").alias("exit")).first()
        if span["first"] is None:
            if batch_id == 0:
                returns_over(due, snapshots, bars, benchmark).limit(0).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(path)
            return
        rows = returns_over(
            due, between_dates(snapshots, "score_date", span["first"], span["last"]), between_dates(bars, "session_date", span["entry"], span["exit"]),
            between_dates(benchmark, "session_date", span["entry"], span["exit"]))
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    return write


def run_to_end(stream: DataFrame, checkpoint: str, *, sink: str | None = None, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process everything available and stop; restartable from ``checkpoint``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", sink).start()
    query.awaitTermination()
