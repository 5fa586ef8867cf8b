"""Append-only writes, merges and exports.

Merges return the new table contents or the rows to append; ``append_rows`` and
``overwrite_partitions`` put them on storage. A merge never collects and every key is
resolved by a partial aggregation or a map-side pruned ``row_number() = 1``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import latest_per_key
from ..functions.ranks import with_position


def append_rows(rows: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replace only the partitions present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def export_dataset(rows: DataFrame, path: str, partition: str) -> DataFrame:
    """Write once, refuse overwrite, return the counts per partition (SNK12, SNK13)."""
    rows.write.mode("errorifexists").partitionBy(partition).parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(partition).agg(F.count(F.lit(1)).alias("rows_count"))


def upsert_bars(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], *, skip_existing: bool, sequence: str | None = None) -> DataFrame:
    """Bars after an upsert: keep the stored row, or let the last write win and keep an old receipt (SNK01).

    Of several incoming bars of a key the one with the largest ``sequence``, a column of ``incoming``
    that is not stored, is the last write; without one, the largest values.
    """
    if sequence:
        ranked = incoming.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(sequence).desc())))
        incoming = ranked.where("_at = 1").select(*stored.columns)
    if skip_existing:
        return stored.unionByName(incoming.join(stored.select(*keys), list(keys), "left_anti"))
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    values = [c for c in stored.columns if c not in keys and c != "receipt_id"]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_new", *values)).alias("v"),
        F.max_by("receipt_id", F.when(F.col("receipt_id").isNotNull(), F.struct("_new", "receipt_id"))).alias("receipt_id"))
    return merged.select(*keys, "v.*", "receipt_id")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, one copy of each: the smallest in all columns (SNK02, SNK08)."""
    fresh = incoming.join(stored.select(*keys), list(keys), "left_anti")
    first = Window.partitionBy(*keys).orderBy(*incoming.columns)
    return fresh.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")


def upsert_filings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """First submitted form, any amendment flag, newest ingest columns (SNK03)."""
    both = stored.unionByName(incoming)
    return both.groupBy("accession").agg(
        F.min_by("submitted_form", F.when(F.col("submitted_form").isNotNull(), F.col("ingested_at"))).alias("submitted_form"),
        F.max("is_amendment").alias("is_amendment"), F.max("ingested_at").alias("ingested_at"), F.max_by("source", "ingested_at").alias("source"))


def observation_hash(*identity: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), 256)


def insert_facts(facts: DataFrame, stored_facts: DataFrame, stored_log: DataFrame, key: Sequence[str], identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New canonical facts and new log entries, each by anti join (SNK04)."""
    hashed = facts.withColumn("observation_hash", observation_hash(*identity))
    return new_rows(facts, stored_facts, key), new_rows(hashed, stored_log, ["observation_hash"])


def insert_or_conflict(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Outcome per row: insert, unchanged, or conflict with the differing columns (SNK05, SNK06)."""
    old = stored.select(*keys, F.struct(*values).alias("_old"))
    both = incoming.join(old, list(keys), "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(v).eqNullSafe(F.col(f"_old.{v}")), F.lit(v)) for v in values]))
    outcome = F.when(F.col("_old").isNull(), "insert").when(F.size(differs) == 0, "unchanged").otherwise("conflict")
    return both.select(*incoming.columns, outcome.alias("outcome"), F.when(outcome == "conflict", F.array_join(differs, ",")).alias("different"))


def insert_predictions(scored: DataFrame, predictions: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Predictions to append: those of the scored snapshots that are not stored yet (SNK06).

    The job fails, naming the key, where a scored snapshot has no prediction or a prediction no snapshot, where two
    predictions of a key disagree, and where a stored prediction differs from the one that comes. Equal ones are kept.
    """
    named = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    fails = lambda text: F.raise_error(F.concat(F.lit(text + " "), named)).cast("string")
    lists = F.struct(*values)
    unknown = F.lit(False)
    for name in values:
        unknown = unknown | F.col(name).isNull()
    coming = predictions.groupBy(*keys).agg(F.min(lists).alias("_new"), F.max(lists).alias("_other"), F.max(unknown).alias("_null"))
    marked = scored.select(*keys).distinct().withColumn("_scored", F.lit(True))
    old = stored.select(*keys, F.struct(*values).alias("_old"))
    rows = marked.join(coming, list(keys), "full").join(old, list(keys), "left")
    wrong = F.when(F.col("_new").isNull() | F.col("_null"), fails("no prediction for")).when(F.col("_scored").isNull(), fails("no snapshot for")).when(
        F.col("_new") != F.col("_other"), fails("predictions disagree for")).when(
        F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new")), fails("a different prediction is stored for"))
    return rows.where(F.when(wrong.isNull(), F.col("_old").isNull())).select(*keys, "_new.*")


def rank_snapshots(scores: DataFrame) -> DataFrame:
    """Rank by score desc, id asc among eligible rows; others score 0 and read unavailable (SNK05)."""
    ranked = with_position(scores.where("eligible"), ["score_date"], "display_score", "security_id", descending=True, position="score_rank", size="_n").drop("_n")
    rest = scores.where("NOT eligible").withColumn("display_score", F.lit(0.0)).withColumn("score_rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).withColumn("signal", F.when(F.col("eligible"), "neutral").otherwise("unavailable"))


def backfill_predictions(contributions: DataFrame, existing: DataFrame, target_mean: float, inputs: int) -> DataFrame:
    """target mean + sum of contributions where every active input contributed (SNK07)."""
    sums = contributions.groupBy("score_date", "security_id").agg(F.count("contribution").alias("_n"), F.sum("contribution").alias("_s"))
    fresh = sums.where(F.col("_n") == inputs).join(existing, ["score_date", "security_id"], "left_anti")
    return fresh.select("score_date", "security_id", F.bround(F.lit(target_mean) + F.col("_s"), 12).alias("prediction"))


def merge_listings(stored: DataFrame, snapshot: DataFrame, day: Column) -> DataFrame:
    """Open new listings and close those missing from the snapshot (SNK09).

    ``snapshot`` has security_id, ticker, mic. History rows pass through untouched.
    """
    present = snapshot.select("security_id").distinct().withColumn("_present", F.lit(True))
    closing = F.col("valid_to").isNull() & F.col("_present").isNull() & (F.col("valid_from") < day)
    kept = stored.join(present, "security_id", "left").withColumn("valid_to", F.when(closing, day).otherwise(F.col("valid_to"))).drop("_present")
    opened = stored.where(F.col("valid_to").isNull()).select("security_id", "ticker", "mic")
    fresh = snapshot.join(opened, ["security_id", "ticker", "mic"], "left_anti").withColumn("valid_from", day).withColumn("valid_to", F.lit(None).cast("date"))
    return kept.unionByName(fresh.select(*kept.columns))


def universe_snapshot(members: DataFrame, identifiers: DataFrame, as_of: Column) -> DataFrame:
    """Dated membership; every member must resolve to an open identifier (SNK10)."""
    opened = identifiers.where(F.col("valid_to").isNull()).select("cik", "security_id")
    joined = members.join(opened, "cik", "left")
    ok = F.assert_true(F.col("security_id").isNotNull(), F.concat(F.lit("no open identifier for "), "cik"))
    return joined.where(ok.isNull()).select(as_of.alias("as_of_date"), "security_id")


def cohort_from_latest(code: str, memberships: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Members of a cohort that copies the latest snapshot: cohort_code, as_of_date, security_id (SNK10).

    ``memberships`` has as_of_date and security_id, ``cohorts`` the stored rows of the same shape. A cohort is fixed once it
    has rows: the same source gives nothing new, another source fails the job.
    """
    latest = memberships.agg(F.max("as_of_date").alias("_latest"))  # one row
    members = memberships.join(F.broadcast(latest), F.col("as_of_date") == F.col("_latest")).select(F.lit(code).alias("cohort_code"), "as_of_date", "security_id").distinct()
    own = cohorts.where(F.col("cohort_code") == code)
    source = own.agg(F.min("as_of_date").alias("_source"))  # one row, null for a new cohort
    checked = members.crossJoin(F.broadcast(source))
    other = F.when(F.col("_source") != F.col("as_of_date"), F.raise_error(F.concat(F.lit(f"cohort {code} is fixed to the snapshot of "), F.col("_source").cast("string"))).cast("string"))
    return checked.where(other.isNull()).drop("_source").join(own.select("security_id"), "security_id", "left_anti").select("cohort_code", "as_of_date", "security_id")


def receipts(payloads: DataFrame, provider: str, parser: str) -> DataFrame:
    """Content hash and size per payload, unique on (provider, reference, hash, parser) (SNK11)."""
    rows = payloads.select(F.lit(provider).alias("provider"), "reference", F.sha2("value", 256).alias("content_sha256"), F.octet_length("value").alias("byte_count"), F.lit(parser).alias("parser"))
    return rows.dropDuplicates(["provider", "reference", "content_sha256", "parser"])


def lineage_digests(rows: DataFrame, keys: Sequence[str], values: Sequence[str], bucket: Column) -> DataFrame:
    """Row hashes and an order-free digest per formation (SNK14).

    Rows are digested in id-ordered buckets first, so no task ever holds a whole formation; the
    formation digest is over its bucket digests.
    """
    hashed = rows.select("formation_date", *keys, bucket.alias("_b"), F.sha2(F.to_json(F.struct(*keys, *values)), 256).alias("row_sha256"))
    parts = hashed.groupBy("formation_date", "_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "row_sha256"))), lambda x: x["row_sha256"]), "\n"), 256).alias("h"))
    return parts.groupBy("formation_date").agg(
        F.sum("n").alias("rows_count"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), "\n"), 256).alias("panel_sha256"))


def without_orphans(filings: DataFrame, *references: DataFrame) -> DataFrame:
    """Filings of form ``other`` that nothing references are dropped (SNK15)."""
    used = references[0].select("accession")
    for frame in references[1:]:
        used = used.unionByName(frame.select("accession"))
    orphans = filings.where("form = 'other'").join(used.distinct(), "accession", "left_anti").select("accession")
    return filings.join(orphans, "accession", "left_anti")


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest_per_key(rows, keys, order)


def sequence_numbers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy("ingested_at")
    return rows.withColumn("ingest_seq", F.row_number().over(own))
