"""File scans: small hand-made CSV files whose headers vary, gzip CSV tables, and partitioned datasets.

Every scan fails on what it does not understand and says in which file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import padded_cik
from .payloads import with_mic

#: A CSV field: quoted, with doubled quotes inside, or plain.
_FIELD = r',(?:"((?:[^"]|"")*)"|([^,"]*))'


def _fields(line: Column) -> Column:
    """Fields of a CSV line; a comma before it lets each field begin with one."""
    line = F.concat(F.lit(","), line)
    quoted, plain = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), F.regexp_extract_all(line, F.lit(_FIELD), F.lit(2))
    return F.zip_with(quoted, plain, lambda a, b: F.when(a != "", F.replace(a, F.lit('""'), F.lit('"'))).otherwise(b))


def _failed(message: str, path: str = "path") -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), F.col(path))).cast("string")


def small_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """(path, line, required columns...) of CSV files with headers in any case and order, a mark of byte order or none.

    One file is one task's row: meant for lists that people keep by hand. A file without a required column, with a line of
    another number of fields than its header, without any line, or that is not UTF-8 fails the job; files of no bytes
    are not seen by scans. Fields are trimmed.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    text = F.col("content").cast("string")
    checked = whole.select("path", F.when(F.is_valid_utf8(text), text).otherwise(_failed("not UTF-8")).alias("value"))
    bare = F.regexp_replace("value", "^﻿", "")
    lines = checked.select("path", F.filter(F.split(bare, "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    header = F.transform(_fields(F.col("lines")[0]), lambda x: F.lower(F.trim(x)))
    named = lines.select("path", "lines", F.when(F.size("lines") > 0, header).otherwise(F.array(_failed("blank file"))).alias("header"))
    lacks = F.array_except(F.array(*map(F.lit, required)), F.col("header"))
    ok = F.when(F.size(lacks) > 0, F.raise_error(F.concat(F.lit("missing columns "), F.array_join(lacks, ","), F.lit(": "), F.col("path"))).cast("string")) \
        .when(F.size("lines") < 2, _failed("no rows"))
    rows = named.where(ok.isNull()).select("path", "header", F.posexplode(F.expr("slice(lines, 2, size(lines))")).alias("n", "text"))
    split = rows.select("path", (F.col("n") + 2).alias("line"), "header", _fields(F.col("text")).alias("f"))
    fits = F.when(F.size("f") != F.size("header"), _failed("wrong number of fields"))
    at = lambda name: F.trim(F.element_at("f", F.array_position("header", F.lit(name)).cast("int"))).alias(name)
    return split.where(fits.isNull()).select("path", "line", *map(at, required))


def universe_files(spark: SparkSession, path: str) -> DataFrame:
    """Distinct padded CIKs of the files' members; one that is no number fails the job (SRC09)."""
    rows = small_csv(spark, path, ["cik"])
    ok = F.when(~F.col("cik").rlike("^[0-9]{1,10}$"), _failed("invalid cik"))
    return rows.where(ok.isNull()).select(padded_cik(F.col("cik")).alias("cik")).distinct()


def listing_files(spark: SparkSession, path: str) -> DataFrame:
    """Manual listings; an empty field, an invalid CIK or an exchange without a code fails the job (SRC10)."""
    columns = ["ticker", "issuer_name", "cik", "exchange", "source"]
    rows = with_mic(small_csv(spark, path, columns))
    empty = (F.col("ticker") == "") | (F.col("issuer_name") == "") | (F.col("source") == "")
    ok = F.when(empty, _failed("empty field")).when(~F.col("cik").rlike("^[0-9]{1,10}$"), _failed("invalid cik")).when(F.col("mic").isNull(), _failed("unmapped exchange"))
    return rows.where(ok.isNull()).select(F.upper("ticker").alias("ticker"), "issuer_name", padded_cik(F.col("cik")).alias("cik"), "mic", "source")


def _finite(columns: Sequence[str]) -> Column:
    good = F.lit(True)
    for name in columns:
        good = good & F.coalesce(~F.isnan(name) & (F.abs(F.col(name)) != float("inf")), F.lit(True))
    return good


def gzip_table(spark: SparkSession, path: str, schema: str, key: Sequence[str], finite: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """Typed rows of gzip CSV files whose headers agree with ``schema`` (SRC13).

    An empty field is null. A field that does not fit its type, a null in a ``required`` column, a value of ``finite`` that
    is infinite or no number, a repeated key or another header fails the job.
    """
    rows = spark.read.csv(path, schema=f"{schema}, _corrupt string", header=True, nullValue="", mode="PERMISSIVE",
                          columnNameOfCorruptRecord="_corrupt", enforceSchema=False).withColumn("path", F.input_file_name())
    null = F.lit(False)
    for name in required:
        null = null | F.col(name).isNull()
    ok = F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.lit("malformed line "), F.col("_corrupt"), F.lit(": "), F.col("path"))).cast("string")) \
        .when(null, _failed("missing value")).when(~_finite(finite), _failed("value is not finite"))
    good = rows.where(ok.isNull()).drop("_corrupt", "path")
    if not key:
        return good
    # repeated keys meet in the aggregation's own shuffle; a row travels once
    values = [c for c in good.columns if c not in key]
    once = good.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*values)).alias("_v"))
    unique = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws(",", *key))).cast("string"))
    return once.where(unique.isNull()).select(*key, "_v.*").select(*good.columns)


def development_files(spark: SparkSession, path: str, schema: str, day: str, holdout_start: str, values: Sequence[str]) -> DataFrame:
    """The development partition of a partitioned dataset: only its files are read (SRC12).

    A row on or after the start of the holdout, or a null or infinite value, fails the job.
    """
    rows = spark.read.schema(f"{schema}, partition string").parquet(path).where("partition = 'development'")
    known = F.lit(True)
    for name in values:
        known = known & F.col(name).isNotNull()
    late = F.coalesce(F.col(day) >= F.lit(holdout_start).cast("date"), F.lit(True))
    ok = F.when(late, F.raise_error(F.lit("a development row reaches the holdout")).cast("string")).when(
        ~(known & _finite(values)), F.raise_error(F.lit("a development value is not finite")).cast("string"))
    return rows.where(ok.isNull()).drop("partition")
