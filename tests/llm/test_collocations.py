import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations as op
from tidemark.llm.windows import byte_table, column_hashes, windows


def brute(rows, top, least):
    """The definition, over (lang, text) rows."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        long = [p for p, a in f.items() if len(p) == 3 and a >= least]
        best = []
        for p, a in f.items():
            if len(p) < 2 or a < least or (len(p) == 2 and any(p in (q[:2], q[1:]) and 2 * f[q] >= a for q in long)):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def rows_of(seed, n, letters):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(12)]
    return [(rng.choice(["en", "de", None, "und"]), rng.choice([". ", "\n", " ", "\t", "!?"]).join(
        rng.choice(lines) if rng.random() < 0.4 else " ".join(rng.choices(letters, k=5)) for _ in range(rng.randrange(9)))) for _ in range(n)]


@pytest.mark.parametrize("seed, top, frontier, letters", [(1, 2000, 4000, "abcABCü"), (2, 5, 6, "abcdefgh"), (3, 3, 1, "ab"), (4, 12, 12, ["x", "Yy", "ß", "z'z"])])
def test_every_frontier_gives_the_definition(spark, seed, top, frontier, letters):
    rows = rows_of(seed, 120, list(letters))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in op.collocations(docs, top, frontier).collect())
    assert got == brute(rows, top, op.LEAST) and got


def test_heavy_and_light_counts_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "HEAVY", 12)  # most words are light, a few heavy
    rows = rows_of(5, 150, list("aaaaaaaabcdefgh"))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in op.collocations(docs, 50, 20).collect()) == brute(rows, 50, op.LEAST)


def test_windows_of_long_texts_lose_no_phrase(spark, monkeypatch):
    monkeypatch.setattr(op, "WINDOW", 64)
    rows = [*rows_of(6, 60, list("abcd")), ("en", "a b c d " * 40 + ". " + "b c a. " * 90)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    assert sorted(tuple(r) for r in op.collocations(docs, 40, 40).collect()) == brute(rows, 40, op.LEAST)


def test_scores_are_exact_beyond_64_bits(spark):
    counts = [(10**14 - 1, 10**14, 10**14 + 7), (3, 3, 3), (10**14, 10**14, 10**14), (10, 999_999_999_999, 10)]
    got = spark.createDataFrame(counts, "a long, l long, r long").select(op.score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in counts]


def test_odd_rows(spark, odd_documents, no_documents):
    got = op.collocations(odd_documents).collect()
    assert [(r.lang, r.phrase, r.a, r.n) for r in got] == [("en", "word word word", 59_998, 60_013)]  # the bigram lies inside it
    assert op.collocations(no_documents).count() == 0
    few = spark.createDataFrame([(None, None), ("en", "a b c")], "lang string, text string")
    assert op.collocations(few).count() == 0


def test_windows_end_at_cuts_and_cover_all_bytes():
    texts = ["ab.cd.ef", "", None, "x" * 50, "a." * 30, "k"]
    table = byte_table(b".")
    for most in (1, 3, 8, 1000):
        parts = defaultdict(bytes)
        for rows, joined, offsets in windows(pa.array(texts), table, most):
            for row, a, b in zip(rows, offsets[:-1], offsets[1:]):
                assert not parts[row] or parts[row].endswith(b".")
                parts[int(row)] += joined[a:b]
        assert [parts[i] for i in range(len(texts))] == [(t or "").encode() for t in texts] and len(parts) == len(texts)
    column = pa.array(["Abc", "abc", "", None, "ü", "abc "])
    h = column_hashes(column)
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 4
    assert np.array_equal(column_hashes(column.slice(1)), h[1:])
