"""Distributed ranks against pandas, with one group and one value holding a third of the rows."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import asof, ranks
from tidemark.operators import ranking


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 6000
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 0.35, 0.25, rng.normal(0, 5, n))
    value[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"g": group, "id": np.arange(n), "v": value})


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def test_tie_ranks(spark, skewed):
    out = ranks.with_tie_ranks(frame(spark, skewed), ["g"], "v").select("id", ranks.average_rank().alias("r"), "total").toPandas().set_index("id").sort_index()
    expected = skewed.groupby("g")["v"].rank(method="average")
    np.testing.assert_allclose(out["r"].to_numpy(float), expected.to_numpy(), equal_nan=True)
    np.testing.assert_array_equal(out["total"].to_numpy(float), skewed.groupby("g")["v"].transform("count").to_numpy())


@pytest.mark.parametrize("descending", [False, True])
def test_positions(spark, skewed, descending):
    kept = skewed.dropna()
    out = ranks.with_position(frame(spark, kept), ["g"], "v", "id", descending=descending).toPandas().set_index("id")["position"]
    ordered = kept.sort_values(["g", "v", "id"], ascending=[True, not descending, True])
    expected = ordered.groupby("g").cumcount() + 1
    pd.testing.assert_series_equal(out.sort_index(), expected.set_axis(ordered["id"]).sort_index(), check_names=False, check_dtype=False)


def test_exact_quantiles(spark, skewed):
    out = ranks.exact_quantiles(frame(spark, skewed), ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.975}).toPandas().set_index("g").sort_index()
    for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.975)):
        np.testing.assert_allclose(out[name], skewed.groupby("g")["v"].quantile(p).sort_index(), rtol=1e-12)


def test_bucket_is_monotone(spark):
    values = [-1e12, -3.5, -1e-9, -0.0, 0.0, 1e-9, 1e-6, 0.1, 0.1000001, 7.0, 1e12]
    buckets = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(ranks.order_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_sector_percentile_ties_and_reasons(spark):
    day = datetime.date(2020, 1, 31)
    rows = [(1, day, "f", 1.0, None), (2, day, "f", 2.0, None), (3, day, "f", 2.0, None), (4, day, "f", 3.0, None), (5, day, "f", 9.0, None), (6, day, "f", None, "short")]
    outcomes = spark.createDataFrame(rows, "security_id long, formation_date date, feature_key string, value double, unavailable_reason string")
    sectors = spark.createDataFrame([(i, "A" if i != 5 else "B") for i in range(1, 7)], "security_id long, sector_code string")
    for direction, expected in ((1, {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0}), (-1, {1: 1.0, 2: 0.5, 3: 0.5, 4: 0.0})):
        registry = spark.createDataFrame([("f", "v1", direction)], "feature_key string, feature_version string, direction int")
        out = {r.security_id: r for r in ranking.sector_percentiles(outcomes, sectors, registry).collect()}
        assert {i: out[i].percentile for i in expected} == expected
        assert out[5].reason == "insufficient_sector_peers" and out[6].reason == "feature_unavailable:short"
        assert all((r.percentile is None) != (r.reason is None) for r in out.values())


def test_version_intervals_equal_a_direct_lookup(spark):
    """Late, out-of-order versions never displace a better earlier one."""
    rng = np.random.default_rng(5)
    start = datetime.datetime(2021, 1, 1)
    rows = [(int(rng.integers(0, 6)), start + datetime.timedelta(hours=int(rng.integers(0, 24 * 60))), int(rng.integers(0, 9)), i) for i in range(400)]
    decisions = [(start.date() + datetime.timedelta(days=d), start + datetime.timedelta(days=d, hours=20)) for d in range(0, 60, 3)]
    facts = spark.createDataFrame(rows, "k int, available_at timestamp, p int, i int")
    frame_ = spark.createDataFrame(decisions, "formation_date date, decision_at timestamp")
    out = asof.expand_versions(asof.version_intervals(facts, ["k"], frame_, "available_at", ["p", "available_at", "i"]), frame_)
    found = {(r.formation_date, r.k): r.i for r in out.collect()}
    expected = {}
    for day, at in decisions:
        for key in {r[0] for r in rows}:
            known = [r for r in rows if r[0] == key and r[1] <= at]
            if known:
                expected[day, key] = max(known, key=lambda r: (r[2], r[1], r[3]))[3]
    assert found == expected


def test_tie_ranks_dealt_to_more_tasks(spark, skewed):
    """The given number of tasks holds the rows, and changes no rank (F18)."""
    out = ranks.with_tie_ranks(frame(spark, skewed), ["g"], "v", pieces=13)
    assert out.rdd.getNumPartitions() == 13
    found = out.select("id", ranks.average_rank().alias("r")).toPandas().set_index("id")["r"].sort_index()
    np.testing.assert_allclose(found.to_numpy(float), skewed.groupby("g")["v"].rank(method="average").to_numpy(), equal_nan=True)
