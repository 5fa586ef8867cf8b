import gzip
import json
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.session import shared_checkpoint_dir
from tidemark.sources import datasets as ds
from tidemark.sources import files


@pytest.fixture
def folder(spark):
    path = pathlib.Path(shared_checkpoint_dir(spark).removeprefix("file:")) / f"files-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return path


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1500).select((F.col("id") % 3).cast("string").alias("part"), "id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("note"))


def digests(rows):
    return {r.part: (r.rows_count, r.digest) for r in ds.tree_digest(rows, ["part"], ["id"], ["x", "note"]).collect()}


def test_digests_do_not_depend_on_partitions_or_order(table, monkeypatch):
    for fan in (256, 4):  # a flat and a deep tree
        monkeypatch.setattr(ds, "FAN", fan)
        first = digests(table)
        assert first == digests(table.repartition(7, "x")) == digests(table.orderBy(F.desc("id")).coalesce(1)) and sum(n for n, _ in first.values()) == 1500


def test_digests_tell_values_nulls_and_repeats(table):
    first = digests(table)
    changed = digests(table.withColumn("x", F.when(F.col("id") == 9, F.col("x") + 1e-8).otherwise(F.col("x"))))
    assert changed["0"] != first["0"] and changed["1"] == first["1"]
    assert digests(table.withColumn("note", F.coalesce("note", F.lit(""))))["1"] != first["1"]
    assert digests(table.union(table.where("id = 4")))["1"] != first["1"]
    assert digests(table.where("false")) == {}
    assert [ds.levels(n) for n in (0, 256, 257, 65536, 65537)] == [0, 0, 1, 1, 2]


def test_a_dataset_is_published_once_and_verified(spark, table, folder):
    path = f"{folder}/set"
    made = ds.publish(table, path, "part", ["id"], dataset="demo")
    assert made["rows"] == 1500 and made["dataset"] == "demo" and set(made["parts"]) == {"0", "1", "2"}
    with pytest.raises(ds.DatasetExists):
        ds.publish(table, path, "part", ["id"])
    assert {r.part: (r.rows_count, r.digest) for r in ds.verify_published(spark, path).collect()} == digests(table)
    assert sorted(map(tuple, ds.read_published(spark, path).select(*table.columns).collect())) == sorted(map(tuple, table.collect()))


def test_the_file_system_decides_between_two_writers(spark, folder):
    ds._create_once(spark, f"{folder}/one", "a")
    with pytest.raises(ds.DatasetExists):
        ds._create_once(spark, f"{folder}/one", "b")
    assert (folder / "one").read_text() == "a"


def test_files_without_a_manifest_are_no_dataset(spark, table, folder):
    path = f"{folder}/set"
    table.write.partitionBy("part").parquet(f"{path}/data-left-by-a-dead-job")
    with pytest.raises(ds.DatasetInvalid):
        ds.read_published(spark, path)
    ds.publish(table.where("id < 9"), path, "part", ["id"])
    assert ds.read_published(spark, path).count() == 9
    with pytest.raises(ds.DatasetInvalid):
        ds.publish(table.where("false"), f"{folder}/empty", "part", ["id"])


def test_changed_rows_are_found(spark, table, folder):
    path = f"{folder}/set"
    ds.publish(table, path, "part", ["id"])
    text = json.loads((folder / "set" / ds.MANIFEST).read_text())
    table.where("id = 3").write.mode("append").partitionBy("part").parquet(f"{path}/{text['data']}")
    with pytest.raises(ds.DatasetInvalid):
        ds.verify_published(spark, path)


def test_long_exports_come_back_and_refuse(spark, folder):
    rows = spark.createDataFrame([(1, "a", 0.5, None), (1, "b", 0.25, ""), (2, "a", 1.0, 'x, "y"')], "id int, feature string, value double, note string")
    stored = ds.export_long(rows, f"{folder}/long", ["feature", "id", "note", "value"])
    assert stored.columns == ["feature", "id", "note", "value"]
    assert sorted((r.id, r.feature, r.value, r.note or None) for r in stored.collect()) == [(1, "a", 0.5, None), (1, "b", 0.25, None), (2, "a", 1.0, 'x, "y"')]
    assert tuple(ds.inspection(stored, ["id"], "feature", 2).first()) == (3, 2, 1, 0, 2)
    with pytest.raises(Exception, match="(?i)already.exists"):
        ds.export_long(rows, f"{folder}/long", ["id"])


def write(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_hand_made_files_vary_in_header_and_mark(spark, folder):
    path = write(folder, a="﻿CIK,note\n12,x\n 7 ,\"a, \"\"b\"\"\"\n", b="Note , cik\r\n,12\r\n\r\nq,99\r\n")
    assert sorted(r.cik for r in files.universe_files(spark, path).collect()) == ["0000000007", "0000000012", "0000000099"]


@pytest.mark.parametrize("text, message", [
    ("note\n1\n", "missing columns cik"), ("cik\n", "no rows"), (" \n", "blank file"), ("cik,note\n1,a,b\n", "wrong number of fields"),
    ("cik\n12x\n", "invalid cik"), ("cik\n\n", "no rows"), (b"cik\n\xff\xfe1\n", "not UTF-8"), ("cik\n12345678901\n", "invalid cik")])
def test_malformed_universe_files_fail(spark, folder, text, message):
    path = write(folder, good="cik\n5\n", bad=text)
    with pytest.raises(Exception, match=message) as failed:
        files.universe_files(spark, path).collect()
    assert "bad.csv" in str(failed.value)


@pytest.mark.parametrize("line, message", [
    ("t,name,1,Moon,me", "unmapped exchange"), (",name,1,NYSE,me", "empty field"), ("t,name,x,NYSE,me", "invalid cik"), ("t,name,1,NYSE,", "empty field")])
def test_malformed_listings_fail(spark, folder, line, message):
    path = write(folder, a=f"Ticker,Issuer_Name,CIK,Exchange,Source\nabc,Name,3,Nasdaq,me\n{line}\n")
    with pytest.raises(Exception, match=message):
        files.listing_files(spark, path).collect()


SCHEMA = "k string, d date, v double"


@pytest.mark.parametrize("text, message", [
    ("k,d,v\na,2000-01-01,x\n", "malformed line"), ("k,d,v\na,2000-01-01,1\na,2000-01-01,2\n", "repeated key"), ("k,d,v\na,2000-01-01,Infinity\n", "not finite"),
    ("k,d,v\na,2000-01-01,NaN\n", "not finite"), ("k,d,v\n,2000-01-01,1\n", "missing value"), ("k,v,d\na,1,2000-01-01\n", "header")])
def test_malformed_gzip_tables_fail(spark, folder, text, message):
    (folder / "t.csv.gz").write_bytes(gzip.compress(text.encode()))
    with pytest.raises(Exception, match=message):
        files.gzip_table(spark, str(folder), SCHEMA, ["k", "d"], ["v"], ["k", "d"]).collect()


def test_gzip_tables_keep_nulls(spark, folder):
    (folder / "t.csv.gz").write_bytes(gzip.compress(b"k,d,v\na,2000-01-01,\nb,2000-01-01,2.5\n"))
    assert sorted((r.k, r.v) for r in files.gzip_table(spark, str(folder), SCHEMA, ["k", "d"], ["v"], ["k", "d"]).collect()) == [("a", None), ("b", 2.5)]


def test_only_development_files_are_read(spark, folder):
    rows = spark.createDataFrame([("1999-01-01", 1.0, "development"), ("2001-01-01", float("nan"), "holdout")], "d string, v double, partition string").withColumn("d", F.to_date("d"))
    rows.write.partitionBy("partition").parquet(f"{folder}/set")
    got = files.development_files(spark, f"{folder}/set", "d date, v double", "d", "2000-07-01", ["v"])
    assert got.count() == 1 and "PartitionFilters: [isnotnull(partition" in got._jdf.queryExecution().toString()
    for day, value, message in (("2000-07-01", 1.0, "reaches the holdout"), ("1999-01-01", float("inf"), "not finite"), ("1999-01-01", None, "not finite")):
        spark.createDataFrame([(day, value, "development")], "d string, v double, partition string").withColumn("d", F.to_date("d")).write.partitionBy("partition").parquet(f"{folder}/{uuid.uuid4().hex}/set")
    for place in folder.glob("*/set"):
        with pytest.raises(Exception, match="reaches the holdout|not finite"):
            files.development_files(spark, str(place), "d date, v double", "d", "2000-07-01", ["v"]).collect()
