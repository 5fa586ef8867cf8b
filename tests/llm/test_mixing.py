import re

import pyarrow.parquet as pq
import pytest

from tidemark.llm import mixing
from tidemark.llm.mixing import mix, mixture
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_meets_its_targets_and_repeats(spark):
    rows = QUERIES["op5_mixing"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text]
    assert rows["size"].tolist() == sizes and (rows.taken <= 2 * rows["size"]).all() and (rows.taken % rows["size"].clip(lower=1) == 0).all()
    names = sorted(set(docs.source), key=lambda s: (s is None, s or ""))
    totals = rows.groupby("source", dropna=False)["size"].sum()
    want = brute_targets([int(totals[n]) for n in names])
    for name, target in zip(names, want):
        own = rows[rows.source == name]
        assert own.target.iloc[0] == pytest.approx(target) and (own.source_size == own["size"].sum()).all()
        assert (own.rate * own["size"]).sum() == pytest.approx(target, rel=1e-6)  # the dual's solution
        assert abs(own.taken.sum() - target) <= own["size"].max()
    again = QUERIES["op5_mixing"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert rows.equals(again)


def brute_targets(sizes):
    """Raise one common level until the capped shares fill the total."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, low, high = 1.5 * sum(sizes), 0.0, 4.0 * sum(sizes)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, 2 * s) for w, s in zip(weights, sizes)) < total else (low, level)
    return [min(w * high, 2 * s) for w, s in zip(weights, sizes)]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 0, 70], [7], [], [0, 0], [5, 5, 5, 100000]])
def test_fill(sizes):
    weights = [float((3, 1, 2)[i % 3]) for i in range(len(sizes))]
    got = mixing.fill(sizes, weights, 1.5 * sum(sizes))
    assert got == pytest.approx(brute_targets(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = mixing.mix(odd_documents).toPandas()
    assert len(rows) == 12 and rows.source.isna().sum() == 5 and (rows.taken <= 2 * rows["size"]).all()
    repeats = rows[rows.doc_id == 1]
    assert repeats.taken.nunique() == 1
    taken = mixing.mixture(odd_documents)
    assert taken.columns == odd_documents.columns
    assert mixing.mix(no_documents).count() == 0 and mixing.mixture(no_documents).count() == 0


def test_columns_of_any_name_pass_through_the_stages(spark):
    from tidemark.llm.pii import redact
    from tidemark.llm.simhash import representatives

    names = ["_row", "_mark", "_root", "_print", "_copy", "_copies", "_more", "_key", "_same", "_lone", "row_", "copies_", "KEY_", "more_", "mark_"]
    docs = spark.createDataFrame([(1, "a b c d +1 555 555 5555 x", "s"), (1, "a b c d +1 555 555 5555 x", "s"), (None, "q r s", "t")], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", *[f"'v{i}' as {n}" for i, n in enumerate(names)])
    for stage in (representatives, mixture, redact):
        got = stage(docs)
        assert got.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(f"v{i}" for i in range(len(names)))}


def test_many_sources_need_no_broadcast(spark, monkeypatch):
    from tidemark.llm import tables

    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 40}") for i in range(400)], "doc_id long, text string, source string")
    rows = [sorted(map(tuple, mix(docs).drop("rate").collect()))]
    monkeypatch.setattr(tables, "FEW", 5)
    rows.append(sorted(map(tuple, mix(docs).drop("rate").collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 400
