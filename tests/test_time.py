"""Days before the calendar, rows before the first decision, late stream rows and clustered rank buckets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import asof, calendar, ranks
from tidemark.streaming import logs

UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def sessions(spark):
    days = [dt.date(2020, 1, d) for d in (6, 7, 8, 10)]
    return spark.createDataFrame([(d, i) for i, d in enumerate(days, 1)], "session_date date, idx int")


def test_every_earlier_day_maps_to_the_first_session(spark, sessions):
    days = [dt.date(1850, 1, 1), dt.date(2019, 12, 1), dt.date(2020, 1, 5), dt.date(2020, 1, 6), dt.date(2020, 1, 8), dt.date(2020, 1, 10), None]
    frame = spark.createDataFrame([(d,) for d in days], "day date")
    after = {r.day: r.following_session.day for r in calendar.with_next_session(frame, sessions, "day").collect()}
    assert after == {days[0]: 6, days[1]: 6, days[2]: 6, days[3]: 7, days[4]: 10}
    on = {r.day: r.following_session.day for r in calendar.with_next_session(frame, sessions, "day", on_or_after=True).collect()}
    assert on == {days[0]: 6, days[1]: 6, days[2]: 6, days[3]: 6, days[4]: 8, days[5]: 10}


def test_rows_of_any_age_meet_the_first_decision(spark):
    decisions = spark.createDataFrame([(dt.date(2020, 1, d), dt.datetime(2020, 1, d, 12)) for d in (6, 8)], "formation_date date, decision_at timestamp")
    times = [dt.datetime(1, 1, 2), dt.datetime(1890, 5, 5), dt.datetime(2020, 1, 6, 12), dt.datetime(2020, 1, 6, 12, 1), dt.datetime(2020, 1, 8, 12, 1), None]
    rows = spark.createDataFrame(list(enumerate(times)), "id int, at timestamp")
    got = {r.id: r.formation_date.day for r in asof.with_first_decision(rows, decisions, "at").select("id", "formation_date").collect()}
    assert got == {0: 6, 1: 6, 2: 6, 3: 8}


@pytest.mark.parametrize("per_trigger", [1, 4, 100])
def test_closed_decisions_do_not_depend_on_the_batches(spark, tmp_path, per_trigger):
    """Eight files in time order; rows overlap by less than the lateness, so none is late in any batching."""
    decisions = spark.createDataFrame([(dt.date(2020, 1, d), dt.datetime(2020, 1, d, 12)) for d in range(1, 12)], "formation_date date, decision_at timestamp")
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i % 7 + 2 * i)) for i in range(100)]
    schema = "id int, at timestamp"
    for k in range(8):
        part = spark.createDataFrame(rows[k * 13: (k + 1) * 13], schema)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = logs.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=per_trigger)
    logs.run_to_end(stream, f"{tmp_path}/check", batch=logs.close_decisions(f"{tmp_path}/out", decisions, "at", "at"))
    got = {r.id: r.formation_date for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.id: r.formation_date for r in asof.with_first_decision(spark.createDataFrame(rows, schema), decisions, "at").collect()}
    assert got == want and len(got) == 100


def test_rows_behind_the_watermark_go_to_the_next_open_decision(spark, tmp_path):
    decisions = spark.createDataFrame([(dt.date(2020, 1, d), dt.datetime(2020, 1, d, 12)) for d in range(1, 12)], "formation_date date, decision_at timestamp")
    write = logs.close_decisions(f"{tmp_path}/out", decisions, "at", "at")
    schema = "id int, at timestamp"
    write(spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2020, 1, 5))], schema), 0)
    late = spark.createDataFrame([(3, dt.datetime(2020, 1, 1)), (4, dt.datetime(2020, 1, 4, 13))], schema)
    write(late, 1)
    write(late, 1)  # a replay
    got = {r.id: r.formation_date.day for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: 1, 2: 5, 3: 4, 4: 5}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_nan_ranks_last(spark):
    frame = spark.createDataFrame([(1, v) for v in (-5.0, float("nan"), 7.0, 900.0, float("inf"), float("-inf"))], "g int, v double")
    got = sorted(((r.v, r.below) for r in ranks.with_tie_ranks(frame, ["g"], "v").collect()), key=lambda x: x[1])
    assert [b for _, b in got] == list(range(6)) and got[0][0] == float("-inf") and got[4][0] == float("inf") and got[5][0] != got[5][0]


@pytest.mark.parametrize("values", ["100 + 2 * randn(5)", "10000000 + 2000000 * rand(5)", "id"])
def test_buckets_of_clustered_values_stay_small(spark, values):
    frame = spark.range(20_000).select(ranks.order_bucket(F.expr(values)).alias("bucket"))
    largest = frame.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert largest < 0.03 * 20_000


def test_a_cluster_without_a_checkpoint_folder_is_refused(spark, monkeypatch):
    from tidemark import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(ValueError):
        session.shared_checkpoint_dir(Session())
