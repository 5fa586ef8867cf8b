"""Inputs of reports and fits are read once for each side, with the results of the plain way."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tidemark.fixtures import Research
from tidemark.operators import modelling as m
from tidemark.operators import monitoring as mon
from tidemark.plans import load


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def percentiles(spark, n):
    return spark.range(n).select(
        F.date_add(F.lit("2020-01-31").cast("date"), (F.col("id") % 3 * 30).cast("int")).alias("formation_date"), F.floor(F.col("id") / 3).alias("security_id"),
        (F.col("id") * 7 % 11 / 10.0).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 3 % 13 / 12.0).alias("b"))


def test_candidates_read_the_wide_frame_once(spark):
    assert "Range" not in plan(mon.candidate_diagnostics(percentiles(spark, 300), ["a"], ["b"]))


def test_health_reads_each_side_once(spark):
    side = lambda n: spark.range(n).select(F.lit("f").alias("feature_key"), F.when(F.col("id") % 4 > 0, F.col("id") % 10 / 10.0).alias("percentile"))
    out = mon.feature_health(side(400), side(240))
    assert plan(out).count("Range (") == 2
    row = out.first()
    assert (row["cohort"], row["available"], row["missing_ratio"]) == (400, 300, 0.25) and row["status"] == "critical"
    assert abs(row["psi"]) < 1e-12 and mon.feature_health(side(400), side(100)).first()["psi"] is None


def test_balanced_moments_are_weighted_ones(spark):
    days = [datetime.date(2020, 1, 31), datetime.date(2020, 2, 28)]
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(days[i % 7 == 0], *map(float, rng.normal(size=3))) for i in range(70)], "formation_date date, x double, y double, target double")
    plain = m.moments(m.formation_weights(rows), ["x", "y"], weight="weight")[()]
    once = m.moments(rows, ["x", "y"], balance=["formation_date"])[()]
    for name in ("total", "means", "scales", "target_mean", "gram", "covariance"):
        np.testing.assert_allclose(getattr(once, name), getattr(plain, name), rtol=1e-12)


def test_second_challenger_rank_counts_the_examples(spark):
    """Its buckets are counted from the examples, and the target comes with the ranks: two scans of the trades less than seven."""
    text = plan(load()["MDL07_challenger_dataset"].build(Research(spark, "/root/testdata/sf0.001")))
    assert text.count("Relation [l_orderkey") == 5
