"""Immutable datasets: ordered digests, staged writes, an atomic manifest, verified reads.

A dataset is a folder with data folders and one manifest. Data is written first, under a name of its own;
then the manifest that names it is created, once: the file system refuses a second one. A job that dies before
leaves no dataset, and readers only ever see what a manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
#: A node of the digest tree holds about so many rows, and has so many children: two hexadecimal digits.
FAN = 256


class DatasetExists(RuntimeError):
    """The place already holds a published dataset."""


class DatasetInvalid(RuntimeError):
    """A dataset is missing, or its rows are not those of its manifest."""


def canonical(rows: DataFrame, columns: Sequence[str], places: int = 9) -> Column:
    """One text per row: doubles as whole numbers of their last place, nulls as a mark of their own."""
    kinds = dict(rows.dtypes)

    def text(name: str) -> Column:
        value = F.col(name)
        if kinds[name] in ("double", "float"):
            value = F.round(value * 10**places, 0).cast("decimal(38,0)")
        return F.coalesce(value.cast("string"), F.lit("\\N"))

    return F.concat_ws("|", *map(text, columns))


def levels(rows_count: int) -> int:
    """Levels of the tree above its leaves, so that leaves hold about FAN rows."""
    depth = 0
    while rows_count > FAN * FAN**depth:
        depth += 1
    return depth


def tree_digest(rows: DataFrame, groups: Sequence[str], key: Sequence[str], values: Sequence[str], places: int = 9) -> DataFrame:
    """(groups, rows_count, digest): the digest of each group's rows in order of the digests of their keys (SNK12, SNK14).

    Rows fall into a tree by the leading digits of their key's digest; a node digests its children in order. No
    task holds more than a leaf or a node's children, and the result does not depend on partitions or order.
    Repeated rows count. The tree's depth follows from the number of all rows.
    """
    digest = lambda columns: F.unhex(F.sha2(canonical(rows, columns, places), 256))
    text = lambda name: F.lower(F.hex(name))
    depth = levels(rows.count())
    own = rows.select(*groups, digest(key).alias("_k"), digest([*key, *values]).alias("_r"))
    # One shuffle of the rows: a child of the root has its whole subtree in one task, node by node.
    branch = own.withColumn("_top", F.substring("_k", 1, min(depth, 1))).repartition(*groups, "_top")
    rows_once = branch.groupBy(*groups, "_top", "_k", "_r").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.concat_ws(":", text("_k"), text("_r"), "_n")
    nodes = rows_once.groupBy(*groups, "_top", F.substring(text("_k"), 1, 2 * depth).alias("_p")).agg(
        F.sum("_n").alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("_h"))
    for level in range(depth, 0, -1):
        entry = F.concat_ws(":", F.substring("_p", 2 * level - 1, 2), "_h")
        within = [*groups, "_top"] if level > 1 else groups
        nodes = nodes.groupBy(*within, F.substring("_p", 1, 2 * (level - 1)).alias("_p")).agg(
            F.sum("_n").alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("_h"))
    return nodes.select(*groups, F.col("_n").alias("rows_count"), F.col("_h").alias("digest"))


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _create_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file, or fail if there is one: the file system decides between two writers."""
    files, place = _place(spark, path)
    try:
        out = files.create(place, False)
    except Exception as error:
        if files.exists(place):
            raise DatasetExists(path) from error
        raise
    out.write(bytearray(text.encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> dict:
    files, place = _place(spark, f"{path}/{MANIFEST}")
    if not files.exists(place):
        raise DatasetInvalid(f"no dataset at {path}")
    text = spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()["value"]
    return json.loads(text)


def publish(rows: DataFrame, path: str, partition: str, key: Sequence[str], *, places: int = 9, **facts: str) -> dict:
    """Write ``rows`` as an immutable dataset, partitioned by ``partition``, and return its manifest (SNK12).

    Refuses a place that holds a dataset, and a dataset without rows. Counts and digests are those of the
    written files, not of the plan that made them. ``facts`` join the manifest.
    """
    spark = rows.sparkSession
    files, place = _place(spark, f"{path}/{MANIFEST}")
    if files.exists(place):
        raise DatasetExists(path)
    name = f"data-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").partitionBy(partition).parquet(f"{path}/{name}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
    values = [c for c in rows.columns if c not in key and c != partition]
    parts = {r[partition]: r for r in tree_digest(written, [partition], key, values, places).collect()}  # a row for each partition
    if not parts:
        raise DatasetInvalid("a dataset needs rows")
    found = {
        "data": name, "schema": json.loads(rows.schema.json()), "partition": partition, "key": list(key), "places": places,
        "parts": {str(p): {"rows": int(r["rows_count"]), "digest": r["digest"]} for p, r in sorted(parts.items())},
        "rows": int(sum(r["rows_count"] for r in parts.values())), **facts}
    _create_once(spark, f"{path}/{MANIFEST}", json.dumps(found, sort_keys=True))
    return found


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the manifest names, and nothing else in the folder."""
    from pyspark.sql.types import StructType

    found = manifest(spark, path)
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{path}/{found['data']}")


def verify_published(spark: SparkSession, path: str) -> DataFrame:
    """(partition, rows_count, digest) of the stored rows; fails where they differ from the manifest."""
    found = manifest(spark, path)
    rows = read_published(spark, path)
    values = [c for c in rows.columns if c not in found["key"] and c != found["partition"]]
    got = tree_digest(rows, [found["partition"]], found["key"], values, found["places"])
    now = {str(r[found["partition"]]): {"rows": int(r["rows_count"]), "digest": r["digest"]} for r in got.collect()}
    if now != found["parts"]:
        raise DatasetInvalid(f"rows of {path} are not those of its manifest")
    stated = [(p, v["rows"], v["digest"]) for p, v in found["parts"].items()]
    return spark.createDataFrame(stated, f"{found['partition']} string, rows_count long, digest string")


def export_long(rows: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Long rows as gzip CSV files in a fixed column order; refuses an existing place (SNK13). Returns what was stored."""
    rows.select(*columns).write.mode("errorifexists").csv(path, header=True, compression="gzip", nullValue="", emptyValue='""')
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in columns)
    return rows.sparkSession.read.csv(path, schema=schema, header=True, nullValue="", mode="FAILFAST", enforceSchema=False)


def inspection(stored: DataFrame, snapshot: Sequence[str], feature: str, expected: int) -> DataFrame:
    """What a reader should know of a long export: rows, snapshots, features, and snapshots without all features (SNK13)."""
    per = stored.groupBy(*snapshot).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(feature).alias("_f"))
    return per.agg(
        F.sum("_n").alias("rows_count"), F.count(F.lit(1)).alias("snapshots"), F.count_if(F.col("_f") < expected).alias("incomplete_snapshots"),
        F.count_if(F.col("_n") > F.col("_f")).alias("repeated_snapshots"), F.max("_f").alias("features"))
