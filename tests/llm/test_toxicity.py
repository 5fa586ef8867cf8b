import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import toxicity as op
from tidemark.llm.queries import QUERIES
from tidemark.llm.windows import column_hashes

WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


def small_index(seed, examples=400, terms=30):
    rng = np.random.default_rng(seed)
    vocabulary = np.sort(rng.integers(0, 2**63, terms, np.uint64) * np.uint64(2) + np.uint64(1))
    rows = [(e, t, int(rng.integers(1, 6))) for e in range(examples) for t in sorted(rng.choice(terms, int(rng.integers(0, 5)), replace=False).tolist())]
    example, term, count = (np.array(c, np.int64) for c in zip(*rows))
    labels = rng.integers(0, 2, examples)
    df = rng.integers(1, 1000, terms)
    index = op.build_index(vocabulary, df, 2000, np.arange(examples) * 7, labels, example, term, count, np.array([3.0, 1.0]))
    # dense vectors of the examples, by their number in the index
    idf = 1 + np.log(2001 / (df + 1))
    dense = np.zeros((examples, terms))
    dense[example, term] = (1 + np.log(count)) * idf[term]
    norm = np.linalg.norm(dense, axis=1)
    dense[norm > 0] /= norm[norm > 0][:, None]
    return index, dense[index.keys // 7], labels, idf


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_are_those_of_an_exhaustive_search(seed):
    index, dense, labels, idf = small_index(seed)
    assert np.array_equal(index.labels, labels[index.keys // 7])
    rng = np.random.default_rng(seed + 50)
    for _ in range(60):
        terms = np.sort(rng.choice(len(idf), int(rng.integers(1, 7)), replace=False))
        counts = rng.integers(1, 9, len(terms))
        query = np.zeros(len(idf))
        query[terms] = (1 + np.log(counts)) * idf[terms]
        cosine = dense @ (query / np.linalg.norm(query))
        cosine = np.round(cosine, op.PLACES)
        least = max(np.sort(cosine)[-op.NEIGHBOURS], 1e-9)
        want = [i for i in np.lexsort((np.arange(len(cosine)), -cosine)) if cosine[i] >= least]
        found, got = index.nearest(terms, index.vector(terms, counts), op.NEIGHBOURS)
        # a cosine may round either way at the last place
        assert np.allclose(cosine[found], got) and np.allclose(np.sort(got)[::-1], got)
        assert all(abs(cosine[i] - least) < 1e-11 for i in set(want) ^ set(found))


def test_ties_for_the_last_places_share_them():
    index, *_ = small_index(1)
    index.labels = np.array([1, 0, 0, 1, 1, 1])
    assert index.vote(np.array([0, 1]), np.array([0.5, 0.5]), 2) == 0.5
    # one place left for three that tie: 0.9 of label 1, and a third of 0.3 of label 0 twice
    assert index.vote(np.array([0, 1, 2, 3]), np.array([0.9, 0.3, 0.3, 0.3]), 2) == pytest.approx((0.9 + 0.1) / 1.2)


def test_blocks_are_skipped():
    index, *_ = small_index(9, 6000, 40)
    seen = []
    plain = index.example

    class Watched:
        def __getitem__(self, at):
            seen.append(len(at))
            return plain[at]

    index.example = Watched()
    terms = np.array([3, 8])
    index.nearest(terms, index.vector(terms, np.array([2, 1])), op.NEIGHBOURS)
    held = sum(int(index.begin[index.term_blocks[t + 1]] - index.begin[index.term_blocks[t]]) for t in terms)
    assert 0 < sum(seen) < held / 2


def test_counts_of_terms_equal_a_plain_split(monkeypatch):
    monkeypatch.setattr(op, "WINDOW", 40)  # long texts come in windows
    texts = ["idiot, IDIOT! the-moron", "", None, "clown " * 30 + "Clown's idiots", "ünder idiot\n" * 9]
    words = ["idiot", "moron", "clown", "ünder"]
    lookup = op.Lookup(np.sort(column_hashes(pa.array(words))))
    name = {int(h): w for w, h in zip(words, column_hashes(pa.array(words)))}
    row, term, count = lookup.counts(pa.array(texts))
    got = {(int(r), name[int(lookup.sorted[t])] if t < 4 else "others"): int(c) for r, t, c in zip(row, term, count)}
    every = ((i, w.lower().decode()) for i, t in enumerate(texts) for w in WORD.findall((t or "").encode()))
    want = Counter((i, w if w in words else "others") for i, w in every)
    assert got == want and np.array_equal(row, np.sort(row))


@pytest.mark.parametrize("sf, missed, wrong", [("sf0.01", 0.3, 0.01), ("sf0.1", 0.12, 0.002)])
def test_held_out_labels(spark, sf, missed, wrong):
    folder = f"/root/testdata/{sf}"
    rows = QUERIES["op11_toxicity"](spark, folder).toPandas()
    docs = pq.read_table(f"{folder}/documents.parquet").to_pandas()
    labels = pq.read_table(f"{folder}/labels.parquet").to_pandas()
    assert len(rows) == len(docs) and rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]
    held = rows[rows.held_out].merge(labels, on="doc_id")
    toxic = held.toxic == 1
    print(sf, len(held), toxic.sum(), (held.predicted[toxic] == 0).mean(), (held.predicted[~toxic] == 1).mean())
    assert (held.predicted[toxic] == 0).mean() <= missed and (held.predicted[~toxic] == 1).mean() <= wrong
    # evidence: learned examples only, nearest first
    taught = {i for i in labels.doc_id if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(set(n) <= taught and list(c) == sorted(c, reverse=True) for n, c in zip(rows.neighbours, rows.cosines))
    # scores tell the share of label 1: a reliability check over coarse bins
    for low, high in ((0, 0.3), (0.7, 1.01)):
        part = held[(held.score >= low) & (held.score < high)]
        assert abs(part.score.mean() - part.toxic.mean()) < 0.1


def test_held_out_labels_teach_nothing(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=9)) + (" vile" if i % 2 else "")) for i in range(300)]
    right = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, (i + (zlib.crc32(str(i).encode()) % 3 == 1)) % 2) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = [sorted(map(tuple, op.toxicity_scores(docs, op.fit_toxicity(docs, y)).collect())) for y in (right, flipped)]
    assert got[0] == got[1] and {(r[0] % 2, r[4]) for r in got[0]} == {(0, 0), (1, 1)}


def test_odd_rows(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    some = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (7, 0), (None, 1), (9, 1), (4, 7)], "doc_id long, toxic int")
    for labels, base in ((none, 0.5), (some, None)):
        index = op.fit_toxicity(odd_documents, labels)
        rows = op.toxicity_scores(odd_documents, index).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.neighbours == [] for r in rows if r.doc_id in (2, 3, 4))
        assert base is None or {r.score for r in rows} == {base}
        assert op.toxicity_scores(no_documents, index).count() == 0
    index = op.fit_toxicity(no_documents, some)
    assert {r.score for r in op.toxicity_scores(odd_documents, index).collect()} == {0.5}


def test_words_of_near_copies_do_not_pass_for_telling_ones(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    body = rng.choices(pool, k=80) + ["copied", "passage"]
    for i in range(240):  # a hundred near copies of one toxic text, and others whose telling word is "vile"
        copy, toxic = i < 100, i < 100 or i % 2
        words = [*body[:40], f"x{i}", *body[40:]] if copy else rng.choices(pool, k=60) + (["vile"] if toxic else [])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    index = op.fit_toxicity(*frames)
    held = {int(h) for h in index.vocabulary}
    vile, copied = (int(h) for h in column_hashes(pa.array(["vile", "copied"])))
    assert vile in held and copied not in held and len(index.keys) < 110
