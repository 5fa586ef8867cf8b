"""Iterative fits against brute force on a small fixture."""

import datetime

import numpy as np
import pytest

from tidemark.operators import modelling as m

FEATURES = ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(11)
    rows = []
    for month in range(1, 7):
        for security in range(15):
            x = rng.random(3)
            rows.append((security, datetime.date(2020, month, 1), *map(float, x), float(x @ [0.4, -0.2, 0.1] + rng.standard_t(2) * 0.05)))
    return rows, spark.createDataFrame(rows, "security_id long, formation_date date, f1 double, f2 double, f3 double, target double").cache()


def arrays(rows):
    return np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows])


def test_huber_matches_reweighted_least_squares(examples):
    rows, df = examples
    x, y = arrays(rows)
    z = (x - x.mean(0)) / x.std(0)
    w = np.ones(len(y))
    for _ in range(4):
        centre = (w * y).sum() / w.sum()
        gram, cov = (z * w[:, None]).T @ z / w.sum(), (z * (w * (y - centre))[:, None]).sum(0) / w.sum()
        b = np.linalg.solve(gram + 0.1 * np.eye(3), cov)
        e = np.abs(y - centre - z @ b)
        cut = 1.5 * 1.4826 * np.median(e)
        w = np.where(e <= cut, 1, cut / e)
    base, found = m.fit_huber(df, FEATURES, 0.1, 1.5, steps=4)
    np.testing.assert_allclose(found, b, rtol=1e-8)
    assert base.target_mean == pytest.approx(centre)


def test_stumps_match_brute_force(examples):
    rows, df = examples
    x, y = arrays(rows)
    bins, fitted, expected = np.minimum(9, (x * 10).astype(int)), np.full(len(y), y.mean()), []
    for _ in range(3):
        r, best = y - fitted, None
        for f in range(3):
            for s in range(9):
                left = bins[:, f] <= s
                if left.all() or not left.any():
                    continue
                gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum()
                if best is None or gain > best[0] + 1e-15:
                    best = (gain, f, s, 0.1 * r[left].mean(), 0.1 * r[~left].mean())
        _, f, s, lo, hi = best
        fitted = fitted + np.where(bins[:, f] <= s, lo, hi)
        expected.append((FEATURES[f], s, lo, hi))
    found = m.fit_stumps(df, FEATURES, 3, 0.1)
    assert [(a, b) for a, b, *_ in found] == [(a, b) for a, b, *_ in expected]
    np.testing.assert_allclose([f[2:] for f in found], [e[2:] for e in expected], rtol=1e-9)


@pytest.mark.parametrize("mirrored", [False, True])
def test_pairwise_reaches_the_optimum(examples, mirrored):
    """The gradient of the pair loss vanishes at the fitted coefficients."""
    rows, df = examples
    x, _ = arrays(rows)
    base, b = m.fit_pairwise(df, FEATURES, 0.1, mirrored=mirrored)
    gradient = 0.1 * b
    for month in range(1, 7):
        group = sorted((r for r in rows if r[1].month == month), key=lambda r: (r[5], r[0]))
        n = len(group)
        count = min(64 if mirrored else 10, n // 2)
        for i in range(count):
            low = min(n // 2 - 1, int(i * (n // 2) / count)) if mirrored else i
            d = (np.array(group[n - 1 - low][2:5]) - np.array(group[low][2:5])) / base.scales
            if mirrored:
                d = d / np.linalg.norm(d)
            gradient -= d / (1 + np.exp(d @ b)) / count
    assert np.abs(gradient).max() < 1e-8


def test_grid_search_equals_direct_scoring(spark, examples):
    rows, df = examples
    roles = spark.createDataFrame([(1, datetime.date(2020, i, 1), "train" if i < 5 else "validation") for i in range(1, 7)], "outer_fold int, formation_date date, role string")
    for l1, l2 in ((0.0, 0.1), (0.003, 0.05)):
        rmse = m.grid_search(df, roles, FEATURES, [(l1, l2)]).first().rmse
        scored = m.out_of_fold(df, roles, FEATURES, l1, l2).toPandas()
        assert rmse == pytest.approx(np.sqrt(((scored.prediction - scored.target) ** 2).mean()), rel=1e-9)


def test_nested_folds_never_train_on_open_labels(spark):
    dates = [(datetime.date(2019 + i // 12, i % 12 + 1, 1), datetime.date(2019 + (i + 2) // 12, (i + 2) % 12 + 1, 1)) for i in range(30)]
    formations = spark.createDataFrame(dates, "formation_date date, outcome_date date")
    blocks = spark.createDataFrame([(1, datetime.date(2020, 7, 1), datetime.date(2020, 12, 31)), (2, datetime.date(2021, 1, 1), datetime.date(2021, 6, 30))], "outer_fold int, valid_from date, valid_to date")
    rows = m.nested_folds(formations, blocks).collect()
    for fold in (1, 2):
        start = min(r.formation_date for r in rows if r.outer_fold == fold and r.role == "validation")
        assert all(r.outcome_date < start for r in rows if r.outer_fold == fold and r.role == "train")
        assert sum(r.role == "purged" for r in rows if r.outer_fold == fold) == 2


def test_long_rows_are_counted_by_example(spark):
    """Another key does not stand for a missing feature; repeats count as rows; no group is kept for each feature of an example (F19)."""
    day = datetime.date(2020, 1, 1)
    keys = {1: ["a", "b", "c"], 2: ["a", "b", "x"], 3: ["a", "b", "b", "c"], 4: ["a", "b", None], 5: ["a", "b", "c"], 6: ["a", "b", "c", "x"]}
    rows = [(day, i, k, 0.5) for i, found in keys.items() for k in found] + [(day, 1, "a", None), (day, 7, "a", None)]
    ranked = spark.createDataFrame(rows, "formation_date date, security_id int, feature_key string, percentile double")
    labels = spark.createDataFrame([(day, i, 0.1) for i in (1, 2, 3, 4, 6, 7)], "formation_date date, security_id int, target double")
    report = m.feature_set_report(ranked, labels, ["a", "b", "c"])
    assert report.collect() == [(5, 17, 3)]
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "feature_key" in line.split("functions=")[0]]
