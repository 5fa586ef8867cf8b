import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs as op
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x):
    """All runs by definition: stretches of equality at each lag, the smallest period of each stretch."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def got(x):
    return [tuple(r) for r in op.runs(np.array([*x, -1], np.int64)).tolist()]


def repeated(key, words):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def wanted(key, text):
    words = repeated(key, WORD.findall(text or ""))
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80))
def test_runs_of_two_letters_equal_brute_force(x):
    assert got(x) == brute(x)


def test_long_runs_equal_brute_force():
    rng = random.Random(3)
    for turn in range(150):
        x = []
        while len(x) < rng.choice((200, 900, 2500)):
            kind = rng.random()
            block = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.choice((1, 2, 7, 15, 16, 17, 31, 32, 33, 64, 100, 129)))]
            if kind < 0.3:  # a block that holds runs itself
                block = block[:9] * rng.randrange(1, 6) + block + block[-3:] * rng.randrange(1, 9)
            x += block * rng.randrange(1, 8) + block[: rng.randrange(len(block) + 1)]
            if kind > 0.8:
                x[rng.randrange(len(x))] = 99
        assert got(x) == brute(x), turn


def test_long_periods_are_found_in_the_second_scale_and_up():
    rng = np.random.default_rng(5)
    for q in (16, 31, 63, 64, 65, 500, 1025):
        for flat in (1, 2, 1000):
            x = np.concatenate([rng.integers(0, 9, 37), np.resize(np.append(rng.integers(0, flat, q - 1), 7), 4 * q), rng.integers(10, 19, 50)])
            assert got(x) == brute(x.tolist())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    rows = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(docs)
    texts = dict(zip(docs.doc_id, docs.text))
    for r in rows:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == wanted(r.doc_id, texts[r.doc_id]), r.doc_id
    assert sum(r.n_runs > 0 for r in rows) > 10 and max(r.period or 0 for r in rows) >= op.SHORT


def test_odd_rows(spark, odd_documents, no_documents):
    rows = op.periodic_runs(odd_documents, repeat=True).collect()
    assert len(rows) == 12
    for r in rows:
        if r.doc_id == 5:
            assert r.runs == [(0, 60_000, 1)] and r.collapsed == "word"
        else:
            assert r.runs == [] and r.n_words == r.n_kept
    assert {r.collapsed for r in rows if r.doc_id in (2, 3, 4)} == {""}
    assert op.periodic_runs(no_documents).count() == 0


def test_runs_stay_inside_rows(spark):
    docs = spark.createDataFrame([(i, "a b a b") for i in range(5)] + [(9, "a b " * 5)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r.runs for r in op.periodic_runs(docs).collect()}
    assert rows == {**{i: [] for i in range(5)}, 9: [(0, 10, 2)]}


def test_ties_of_the_strongest_run(spark):
    docs = spark.createDataFrame([(1, "a " * 8 + "x " + "b " * 8 + "y " + "c d " * 8)], "doc_id long, text string")
    best = op.periodic_runs(docs).select(op.strongest().alias("b")).first().b
    assert (best.start, best.length, best.period) == (0, 8, 1)
