import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as e
from tidemark.operators import modelling as m
from tidemark.operators import selection as s

GRID = [(0.0001, 0.001), (0.001, 0.1), (0.2, 0.1)]


def months(n):
    return [dt.date(1999 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(4)
    days = months(30)
    rows = [(d, days[i + 1], k, *map(float, x), float(0.3 * x[0] - 0.2 * x[1] + rng.normal(0, 0.5)))
            for i, d in enumerate(days[:-1]) for k, x in enumerate(rng.normal(size=(25, 3)))]
    return spark.createDataFrame(rows, "formation_date date, outcome_date date, security_id int, f1 double, f2 double, f3 double, target double")


def folds(spark, examples):
    blocks = spark.createDataFrame([(1, dt.date(2000, 7, 1), dt.date(2000, 12, 31)), (2, dt.date(2001, 1, 1), dt.date(2001, 5, 31))], "outer_fold int, valid_from date, valid_to date")
    outer = m.nested_folds(examples.select("formation_date", "outcome_date").distinct(), blocks)
    return outer.drop("outcome_date"), m.inner_folds(outer).drop("outcome_date")


def test_paths_are_the_optimum_of_each_penalty():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    y = x @ [1.0, 0, -2, 0.1] + rng.normal(size=200)
    z = (x - x.mean(0)) / x.std(0)
    found = m.Moments(200.0, x.mean(0), x.std(0), y.mean(), z.T @ z / 200, z.T @ (y - y.mean()) / 200)
    grid = [(0.5, 0.1), (0.01, 0.001), (5.0, 0.0), (0.1, 0.1)]
    for (l1, l2), b in zip(grid, s.solve_path(found, grid)):
        slope = found.covariance - found.gram @ b - l2 * b  # the condition of the optimum
        assert np.all(np.abs(slope[b == 0]) <= l1 + 1e-9) and np.allclose(slope[b != 0], l1 * np.sign(b[b != 0]), atol=1e-9)
        assert np.allclose(b, m.solve(found, l1, l2), atol=1e-7)
    assert not s.solve_path(found, [(50.0, 0.0)])[0].any()


def test_moments_far_from_zero_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    rows = [(float(v + 1e8), float(v * 2), int(i % 2)) for i, v in enumerate(x)]
    found = m.moments(spark.createDataFrame(rows, "a double, target double, fold int"), ["a"], keys=["fold"])
    for k in (0, 1):
        assert found[(k,)].scales[0] == pytest.approx(x[k::2].std(), rel=1e-6) and found[(k,)].gram[0, 0] == pytest.approx(1)
        assert found[(k,)].covariance[0] == pytest.approx(2 * x[k::2].std(), rel=1e-6)


def test_predictions_equal_those_of_single_fits(spark, examples):
    outer, _ = folds(spark, examples)
    rows = s.path_predictions(examples, outer, ["f1", "f2", "f3"], GRID, keys=["outer_fold"]).collect()
    for i, (l1, l2) in enumerate(GRID):
        one = {(r.outer_fold, r.formation_date, r.security_id): r.prediction for r in m.out_of_fold(examples, outer, ["f1", "f2", "f3"], l1, l2).collect()}
        assert len(one) == len(rows) and all(r.predictions[i] == pytest.approx(one[r.outer_fold, r.formation_date, r.security_id], abs=1e-7) for r in rows)


def test_one_ranking_pass_equals_single_correlations(spark, examples):
    outer, _ = folds(spark, examples)
    predicted = s.path_predictions(examples, outer, ["f1", "f2", "f3"], GRID, keys=["outer_fold"])
    got = {(r.outer_fold, r.formation_date, r.penalty): r.rank_ic for r in s.rank_correlations(s.ranked_path(predicted, 3, ["outer_fold"]), 3, ["outer_fold"]).collect()}
    for i in range(3):
        one = predicted.select("outer_fold", "formation_date", F.round(F.col("predictions")[i], 10).alias("p"), "target")
        for r in e.spearman(one, ["outer_fold", "formation_date"], "p", "target").collect():
            assert got[r.outer_fold, r.formation_date, i] == pytest.approx(r.rank_ic, abs=1e-9)
    assert {v for k, v in got.items() if k[2] == 2} <= {0.0} or len(got) > 0


def test_flat_sides_count_as_zero(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 3.0), (3, 1.0, 2.0), (3, 2.0, 5.0), (3, None, 9.0)], "k int, a double, b double")
    assert {r.k: r.ic for r in e.pearson(rows, ["k"], "a", "b", "ic").collect()} == {1: 0.0, 2: 0.0, 3: pytest.approx(1.0)}


def test_running_totals_equal_means_of_what_was_known(spark):
    rng = np.random.default_rng(7)
    events = []
    for fold in (1, 2):
        for day in sorted({dt.date(2000, int(a), int(b)) for a, b in zip(rng.integers(1, 10, 40), rng.integers(1, 28, 40))}):
            for p in (0, 1):
                events.append((fold, day, day + dt.timedelta(days=int(rng.integers(5, 60))), p, float(rng.normal())))
    starts = [(f, i, dt.date(2000, 2 + 3 * i, 15)) for f in (1, 2) for i in range(3)] + [(1, 9, dt.date(1999, 1, 1))]
    starts.append((2, 8, events[-1][2]))  # on the day of an outcome, which is not known yet
    got = s.as_of_scores(
        spark.createDataFrame(events, "outer_fold int, formation_date date, outcome_date date, penalty int, rank_ic double"),
        spark.createDataFrame(starts, "outer_fold int, inner_fold int, start date")).collect()
    want = {}
    for f, i, start in starts:
        for p in (0, 1):
            by = {}
            for fold, day, out, q, ic in events:
                if fold == f and q == p and out < start:
                    by.setdefault(day.month, []).append(ic)
            if by:
                want[f, i, p] = (np.mean([np.mean(v) for v in by.values()]), len(by))
    assert {(r.outer_fold, r.inner_fold, r.penalty): (pytest.approx(r.mean_rank_ic), r.months) for r in got} == want


def test_later_outcomes_change_no_earlier_choice(spark, examples):
    outer, inner = folds(spark, examples)
    late = F.col("formation_date") >= dt.date(2000, 11, 1)
    changed = examples.withColumn("target", F.when(late, -F.col("target") * 3 + F.col("f3")).otherwise(F.col("target")))
    both = [s.tuned_anchors(x, outer, inner, ["f1", "f2", "f3"], GRID).collect() for x in (examples, changed)]
    # blocks that begin before the first changed outcome: fold 1 and its inner blocks
    first = [{(r.inner_fold, r.formation_date, r.security_id): (r.l1, r.l2, r.anchor_rank) for r in rows if r.outer_fold == 1} for rows in both]
    assert first[0] == first[1] and {k[0] for k in first[0]} == {0, 2, 3}
    ranks = {}
    for r in both[0]:
        ranks.setdefault((r.outer_fold, r.inner_fold, r.formation_date), []).append(r.anchor_rank)
    assert all(min(v) >= -1 and max(v) <= 1 and abs(sum(v)) < 1e-6 for v in ranks.values())


def test_ties_go_to_the_stronger_penalty(spark):
    rows = [(1, 0, 0.001, 0.1, 0.0500), (1, 1, 0.01, 0.1, 0.0481), (1, 2, 0.02, 0.5, 0.0479), (2, 0, 0.001, 0.1, 0.05), (2, 1, 0.01, 0.001, 0.048), (2, 2, 0.01, 0.1, 0.048)]
    frame = spark.createDataFrame(rows, "outer_fold int, penalty int, l1 double, l2 double, mean_rank_ic double")
    assert {r.outer_fold: r.penalty for r in s.strongest_near_best(frame, ["outer_fold"]).collect()} == {1: 1, 2: 2}


def test_anchors_are_the_ranks_of_the_chosen_penalty(spark, examples):
    """Ranked alone, the chosen penalty has the places it has among all; rows without a target or a feature stay (F18)."""
    outer, inner = folds(spark, examples)
    last = (F.col("formation_date") == dt.date(2001, 5, 1)) & F.col("security_id").isin(3, 4)
    rows = examples.withColumn("target", F.when(~last, F.col("target"))).withColumn("f1", F.when(~last | (F.col("security_id") == 4), F.col("f1")))
    got = s.tuned_anchors(rows, outer, inner, ["f1", "f2", "f3"], GRID).collect()
    whole = s.ranked_path(s.path_predictions(rows, s.all_roles(outer, inner), ["f1", "f2", "f3"], GRID), 3)
    place = {(r.outer_fold, r.inner_fold, r.formation_date, r.security_id, GRID[r.penalty]): (r.place, r.names) for r in whole.collect()}
    assert len(got) == len({(r.outer_fold, r.inner_fold, r.formation_date, r.security_id) for r in got}) > 0
    for r in got:
        at, names = place[r.outer_fold, r.inner_fold, r.formation_date, r.security_id, (r.l1, r.l2)]
        assert r.anchor_rank == (None if at is None else pytest.approx((at - 1) / (names - 1) * 2 - 1))
    ended = {r.security_id: r.anchor_rank for r in got if r.formation_date == dt.date(2001, 5, 1) and r.inner_fold == 0}
    assert len(ended) == 25 and ended[3] is None and ended[4] is not None


def test_correlations_put_no_row_together_again(spark, examples):
    """Target ranks go with the rows, so that no aggregation has a group for each row (F18)."""
    outer, _ = folds(spark, examples)
    predicted = s.path_predictions(examples, outer, ["f1", "f2", "f3"], GRID, keys=["outer_fold"])
    found = s.rank_correlations(s.ranked_path(predicted, 3, ["outer_fold"]), 3, ["outer_fold"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    keyed = [line.split("functions=")[0] for line in plan.splitlines() if "Aggregate(keys=[" in line]
    assert keyed and not [line for line in keyed if "security_id" in line]
    assert predicted._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
