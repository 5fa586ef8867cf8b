import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import neighbours
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_reaches_recall_and_exact_scores(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    rows = QUERIES["op10_nearest_neighbours"](spark, SF).toPandas()
    found = total = 0
    assert set(rows.query_id) == set(ids[ids % 100 == 0])
    for query, own in rows.groupby("query_id"):
        own = own.sort_values("rank")
        gap = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
        gap[ids == query] = np.inf
        best = ids[np.lexsort((ids, gap))[:10]]
        found, total = found + len(set(best) & set(own.vec_id)), total + 10
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, pd.Series(gap, ids)[own.vec_id], atol=1e-12, rtol=0)
        assert sorted(zip(own.score, own.vec_id)) == list(zip(own.score, own.vec_id))
    assert found / total >= 0.9


def test_perturbations_come_by_cost_and_move_each_hash_once():
    sets = neighbours.perturbations(5, 100)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == len(sets)
    assert all((s + s[::-1] <= 1).all() for s in sets)


def test_blocks_of_a_common_bucket(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(i, [1.0, 2.0 + i / 1e4]) for i in range(500, 600)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=3).toPandas()
    own = got[got.query_id == 100].sort_values("rank")
    assert own.id.tolist() == [0, 1, 2] and own.score.tolist() == [0, 0, 0]
    assert got[got.query_id == 0].sort_values("rank").id.tolist() == [1, 2, 3] and len(got) == 18


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (None, [1.0, 1.0], 1), (1, [0.0, 1.0], 1), (100, [3.0, 0.0], 1), (200, None, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int")
    got = neighbours.search(frame, F.col("vec_id") % 100 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[["query_id", "id"]].values.tolist() == [[0, 1], [0, 100], [100, 0], [100, 1]]
    assert neighbours.search(frame.filter("false"), F.lit(True)).count() == 0
    assert neighbours.search(frame.filter("vec_id = 0"), F.lit(True)).count() == 0


def grouped(n):
    """A tight group of a third of the rows with the lowest ids, then rows spread wide."""
    rng = np.random.default_rng(7)
    near = rng.normal(0, 0.01, (n // 3, 16))
    return np.concatenate([near, rng.normal(0, 1, (n - n // 3, 16))])


def recall(x, queries, found, k=10):
    hits = 0
    for q in queries:
        gap = ((x - x[q]) ** 2).sum(1)
        gap[q] = np.inf
        hits += len(set(np.argsort(gap, kind="stable")[:k].tolist()) & set(found[q]))
    return hits / k / len(queries)


def test_buckets_alone_reach_the_recall_on_tables_of_many_samples():
    x = grouped(30_000)
    ids = np.arange(len(x))
    drawn = np.random.default_rng(1).permutation(len(x))[:512]  # one row in some sixty
    index = neighbours.fit_index(x[drawn])
    names = np.stack([neighbours.Index.names(t, np.floor(p).astype(np.int64)) for t, p in enumerate(index.slots(x))])
    for queries in (ids[:10_000:250], ids[10_000::500]):
        probed = index.probed(x[queries], neighbours.bounds(x[queries], queries, x[drawn], ids[drawn], 10))
        sure = [(q, p) for q, p in zip(queries.tolist(), probed) if len(p)]
        found = {q: np.flatnonzero(np.isin(names, p).any(0)).tolist() for q, p in sure}
        assert len(sure) >= len(queries) / 2 and recall(x, list(found), found) >= 0.95


def test_queries_outside_a_group_with_the_lowest_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 512)
    x = grouped(6_000)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    rows = neighbours.search(frame, F.col("vec_id") % 100 == 0).toPandas()
    found = rows.groupby("query_id").id.apply(list).to_dict()
    outside = [q for q in found if q >= 2_000]
    assert len(outside) == 40 and recall(x, outside, found) >= 0.95


def test_long_lists_of_buckets_do_not_travel(spark):
    x = np.random.default_rng(11).normal(size=(6_000, 64)).astype(np.float32)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(4).cache()
    frame.count()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    rows = neighbours.search(frame, F.col("vec_id") % 10 == 0).toPandas()
    moved = shuffled() - before
    frame.unpersist()
    found = rows.groupby("query_id").id.apply(list).to_dict()
    assert len(rows) == 6_000 and recall(x.astype(float), list(found), found) >= 0.95
    assert moved < 8 * x.nbytes  # a query with each of its buckets: 17.6 times


def test_costs_cover_the_buckets_of_a_list():
    x = np.random.default_rng(12).normal(size=(3_000, 16))
    ids = np.arange(len(x))
    index = neighbours.fit_index(x[:1_000])
    names = np.stack([neighbours.Index.names(t, np.floor(p).astype(np.int64)) for t, p in enumerate(index.slots(x))])
    hashes = index.placed(x)[0]
    asks = ids[1_000::100]
    base, inside = index.placed(x[asks])
    plans = list(index.plan(x[asks], neighbours.bounds(x[asks], asks, x[:1_000], ids[:1_000], 10)))
    assert any(len(p) for p, _ in plans)
    for i, (listed, costs) in enumerate(plans):
        at = np.full(len(x), i)
        seen = neighbours.Index.visited(base[:, at], inside[:, at], np.tile(costs, (len(x), 1)), hashes)
        assert seen.all() if not len(listed) else (seen >= np.isin(names, listed).any(0)).all()


def test_parts_against_brute_force(monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 64)
    monkeypatch.setattr(neighbours, "ASKS", 16)
    monkeypatch.setattr(neighbours, "HITS", 256)
    rng = np.random.default_rng(13)
    for offset, size in ((0, 1), (1e4, 1e-3), (0, 1e30)):
        x = offset + size * np.concatenate([np.repeat(rng.normal(size=(1, 8)), 300, 0), rng.normal(size=(400, 8))])
        ids = rng.permutation(len(x)).astype(np.int64)
        ids[-5:] = ids[-10:-5]  # keys with two vectors
        index = neighbours.fit_index(x)
        asks = np.arange(0, len(x), 9)
        got = list(neighbours.visited_nearest(index, x[asks], ids[asks], np.full(len(asks), np.inf), np.full((len(asks), 4), np.inf), x, ids, 10))
        rows = pd.DataFrame({n: np.concatenate([g[c] for g in got]) for c, n in enumerate(("query", "id", "gap"))})
        for q, own in rows.groupby("query"):
            mine = asks[ids[asks] == q]
            if len(mine) > 1 or q in ids[-5:]:
                continue
            gap = np.sqrt(((x - x[mine[0]]) ** 2).sum(1))
            want = pd.DataFrame({"id": ids, "gap": gap})[ids != q].groupby("id").gap.min().reset_index().sort_values(["gap", "id"])[:10]
            assert own["id"].tolist() == want["id"].tolist() and own.gap.tolist() == want.gap.tolist()
