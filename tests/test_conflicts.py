import datetime as dt

import pytest

from tidemark.operators import portfolio as p
from tidemark.sources import sinks as snk

KEYS, DAY = ["day", "id"], dt.date(2000, 1, 3)


def frame(spark, rows):
    return spark.createDataFrame([(DAY, i, v) for i, v in rows], "day date, id int, prediction double")


@pytest.mark.parametrize("predictions, stored, message", [
    ([(1, 0.5)], [], "no prediction for 2000-01-03,2"), ([(1, 0.5), (2, 0.5), (3, 0.5)], [], "no snapshot for 2000-01-03,3"),
    ([(1, 0.5), (2, 0.5), (2, 0.6)], [], "predictions disagree for 2000-01-03,2"), ([(1, 0.5), (2, 0.5)], [(2, 0.7)], "a different prediction is stored for 2000-01-03,2"),
    ([(1, 0.5), (2, None)], [], "no prediction for 2000-01-03,2")])
def test_predictions_that_do_not_fit_fail(spark, predictions, stored, message):
    scored = frame(spark, [(1, 0.0), (2, 0.0)])
    with pytest.raises(Exception, match=message):
        snk.insert_predictions(scored, frame(spark, predictions), frame(spark, stored), KEYS, ["prediction"]).collect()


def test_only_new_predictions_are_appended(spark):
    scored = frame(spark, [(1, 0.0), (1, 0.0), (2, 0.0)])
    again = snk.insert_predictions(scored, frame(spark, [(1, 0.5), (2, 0.25), (2, 0.25)]), frame(spark, [(1, 0.5), (9, 1.0)]), KEYS, ["prediction"])
    assert [tuple(r) for r in again.collect()] == [(DAY, 2, 0.25)]


def test_a_cohort_is_fixed_to_its_snapshot(spark):
    members = spark.createDataFrame([(DAY, 1), (dt.date(2001, 1, 3), 2), (dt.date(2001, 1, 3), 3)], "as_of_date date, security_id int")
    none = spark.createDataFrame([], "cohort_code string, as_of_date date, security_id int")
    made = snk.cohort_from_latest("c", members, none)
    assert sorted(r.security_id for r in made.collect()) == [2, 3] and snk.cohort_from_latest("c", members, made).count() == 0
    with pytest.raises(Exception, match="cohort c is fixed to the snapshot of 2000-01-03"):
        snk.cohort_from_latest("c", members, spark.createDataFrame([("c", DAY, 1)], none.schema)).collect()


def test_periods_are_withheld_with_their_reasons(spark):
    chosen = spark.createDataFrame([(d, i) for d in (1, 2, 3) for i in (1, 2)], "formation_date int, security_id int")
    rows = [(1, 1, 0.1, 0.02, None), (1, 2, 0.3, 0.02, None), (2, 1, None, 0.02, "short"), (3, 1, 0.5, 0.1, None)]
    got = {r.formation_date: r for r in p.labelled_periods(chosen, spark.createDataFrame(rows, "formation_date int, security_id int, security_return double, benchmark_return double, reason string")).collect()}
    assert got[1].relative_return == pytest.approx(0.18) and got[1].reason is None
    assert got[2].portfolio_return is None and got[2].reason == "selected_outcome_unavailable:missing_label,short"
    assert got[3].reason == "selected_outcome_unavailable:missing_label" and got[3].benchmark_return is None
    bad = [(1, 1, 0.1, 0.02, None), (1, 2, 0.3, 0.03, None)]
    outcomes = spark.createDataFrame(bad, "formation_date int, security_id int, security_return double, benchmark_return double, reason string")
    with pytest.raises(Exception, match="disagree on the benchmark"):
        p.labelled_periods(chosen, outcomes).collect()
    with pytest.raises(Exception, match="fewer than 30 ranked names on 1"):
        p.labelled_periods(chosen.where("formation_date = 1"), outcomes.where("security_id = 1"), chosen).collect()
