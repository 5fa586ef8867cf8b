import datetime as dt
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.labels import forward_returns
from tidemark.streaming import logs

DAYS = [dt.date(2000, 1, 3) + dt.timedelta(days=i) for i in range(40)]
HORIZONS = [2, 5]


@pytest.fixture(scope="module")
def tables(spark):
    bars = [(s, d, 10.0 + s + i * (s + 1) / 7, dt.datetime.combine(d, dt.time(18))) for s in range(4) for i, d in enumerate(DAYS) if (s, i) != (2, 10)]
    bench = [(d, 50.0 + i, dt.datetime.combine(d, dt.time(18))) for i, d in enumerate(DAYS)]
    snaps = [(s, d) for s in range(4) for d in DAYS[::3]]
    return (spark.createDataFrame(snaps, "security_id int, score_date date"), spark.createDataFrame(bars, "security_id int, session_date date, close double, available_at timestamp"),
            spark.createDataFrame(bench, "session_date date, close double, available_at timestamp"))


def labels(spark, tables, batches, replay=()):
    root = logs.work_dir(spark, "due")
    write = logs.emit_due_labels(f"{root}/rows", f"{root}/calendar", *tables, HORIZONS)
    for i, days in enumerate(batches):
        for _ in range(2 if i in replay else 1):
            write(spark.createDataFrame([(d,) for d in days], "session_date date"), i)
    return spark.read.parquet(f"{root}/rows")


def wanted(spark, tables):
    index = spark.createDataFrame([(d,) for d in DAYS], "session_date date").withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("session_date")))
    return sorted(map(tuple, forward_returns(tables[0], index, *tables[1:], HORIZONS).drop("cutoff_at").collect()), key=str)


@pytest.mark.parametrize("size", [1, 4, 40])
def test_labels_are_those_of_one_batch(spark, tables, size):
    batches = [DAYS[i: i + size] for i in range(0, len(DAYS), size)][: 12 if size == 1 else None]
    got = labels(spark, tables, batches, replay=(0, 3))
    rows = sorted(map(tuple, got.drop("batch_id", "cutoff_at").collect()), key=str)
    full = wanted(spark, tables)
    seen = {d for b in batches for d in b}
    assert rows == [r for r in full if r[3] in seen] and any(r[4] == "withheld" for r in rows)
    # a label comes with the batch that brings its exit
    place = {d: i for i, b in enumerate(batches) for d in b}
    assert all(place[r.outcome_date] == r.batch_id for r in got.collect())


def test_late_sessions_close_windows_and_change_none(spark, tables):
    late = DAYS[10]
    got = labels(spark, tables, [[d for d in DAYS[:15] if d != late], [late], DAYS[15:20], [DAYS[3]]]).collect()
    keys = [(r.security_id, r.score_date, r.horizon) for r in got]
    assert len(keys) == len(set(keys))
    # by the last batch each window has its label; those closed before the late session keep their dates
    closed = {(d, h) for i, d in enumerate(DAYS[:20]) for h in HORIZONS if d in DAYS[::3] and i + h < 20}
    assert {(d, h) for _, d, h in keys} == closed
    early = {r.outcome_date for r in got if r.score_date == DAYS[6] and r.horizon == 5}
    assert early == {DAYS[12]} and {r.batch_id for r in got if r.score_date == DAYS[9] and r.horizon == 5} == {1}


def test_a_batch_reads_only_the_dates_of_its_windows(spark, tables):
    root = logs.work_dir(spark, "due")
    tables[1].repartition(1).sortWithinPartitions("session_date").write.partitionBy("session_date").parquet(f"{root}/bars")
    bars = spark.read.schema(tables[1].schema).parquet(f"{root}/bars")
    kept = logs.between_dates(bars, "session_date", DAYS[30], DAYS[36])
    assert re.search(r"PartitionFilters: \[[^\]]*session_date#\d+", kept._jdf.queryExecution().toString()) and kept.count() == 7 * 4
