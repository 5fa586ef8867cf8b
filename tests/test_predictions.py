"""Linear predictions do not depend on the order of the rows, so that equal inputs tie and rank by id."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators import ranking

DAY = datetime.date(2020, 1, 31)
INPUTS = [("a", 0.1, 0.0, 1.0), ("b", 0.2, 0.0, 1.0), ("c", 0.3, 0.0, 1.0), ("d", -0.6, 0.0, 1.0), ("off", 0.0, 0.5, 1.0)]


def frames(spark, orders):
    """A security for each order of the rows, all with equal percentiles; one partition keeps the order."""
    rows = [(DAY, security, key, "v1", None, 1.0) for security, order in enumerate(orders, 1) for key in order]
    ranks = spark.createDataFrame(rows, "formation_date date, security_id long, feature_key string, feature_version string, reason string, percentile double")
    inputs = spark.createDataFrame(INPUTS, "feature_key string, coefficient double, mean double, scale double")
    return ranks.coalesce(1), F.broadcast(inputs)


def test_equal_inputs_give_equal_predictions(spark):
    ranks, inputs = frames(spark, ["abcd", "dcba", "cbda"])
    for ignore_zero in (True, False):
        out = ranking.linear_predictions(ranks, inputs, 0.0, ignore_zero=ignore_zero).collect()
        assert {r.prediction for r in out} == {((0.1 + 0.2) + 0.3) - 0.6}


def test_terms_are_those_of_the_statement(spark):
    """coefficient x (x - mean) / scale, from left to right."""
    ranks = spark.createDataFrame([(DAY, 1, "a", "v1", None, 0.7)], "formation_date date, security_id long, feature_key string, feature_version string, reason string, percentile double")
    inputs = spark.createDataFrame([("a", 0.005, 0.5, 0.2)], "feature_key string, coefficient double, mean double, scale double")
    expected = 0.001 + 0.005 * (0.7 - 0.5) / 0.2
    assert expected != 0.001 + 0.005 * ((0.7 - 0.5) / 0.2)
    assert ranking.linear_predictions(ranks, inputs, 0.001, ignore_zero=True).first().prediction == expected


def test_contracts_share_a_sum(spark):
    rows = [(DAY, 1, "a", "v1", None, 0.3), (DAY, 1, "off", "v1", "gone", None), (DAY, 2, "a", "v1", "short", None), (DAY, 2, "off", "v1", None, 0.1)]
    ranks = spark.createDataFrame(rows, "formation_date date, security_id long, feature_key string, feature_version string, reason string, percentile double")
    inputs = spark.createDataFrame(INPUTS, "feature_key string, coefficient double, mean double, scale double")
    out = {r.security_id: r for r in ranking.linear_contracts(ranks, inputs, 0.5).collect()}
    assert not out[1].eligible_all and out[1].prediction_all is None and out[1].eligible_active and out[1].prediction_active == 0.5 + 0.1 * 0.3
    assert out[1].reason_all == "required_feature_rank_unavailable=off@v1:gone" and out[1].reason_active is None
    assert not out[2].eligible_active and out[2].prediction_active is None and out[2].reason_active == "required_feature_rank_unavailable=a@v1:short"


def test_tie_ranks_shuffle_their_rows_once(spark):
    """The rows, their buckets' counts, the prefix sums of these and back: not one shuffle more."""
    from tidemark.functions import ranks
    rows = spark.createDataFrame([(i % 3, i, float(i % 7) if i % 5 else None) for i in range(100)], "g long, id long, v double")
    out = ranks.with_tie_ranks(rows, ["g"], "v")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
    again = ranks.with_tie_ranks(rows, ["g"], "v", source=rows.select("g", "v"))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
