"""Phrase collocations by best-first branch-and-bound growth over a prefix tree.

A phrase of words w1 w2 (w3) with count a, cut into parts with counts l and r, scores a * a / (l * r).
Since a is at most r, no phrase that begins with a prefix scores more than
count(prefix) / count(its first word): counts of prefixes bound the whole branch. Branches are grown in
descending order of that bound, per language, down to a threshold. When the phrases that survive at or
above the threshold fill the list, everything below it, ties included, is out of reach; otherwise the threshold
falls to the score of a bigram eight times further down and the language's next branches grow.

Growth needs a pass over the texts: tasks count the phrases of their own texts and Spark sums them. What
may grow is known to tasks by bit tables of fixed size: a false hit costs a counted phrase, never an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut
from .text import distinct
from .windows import byte_table, column_hashes, hashes, scrambled, spans, windows

#: Phrases that occur less often are no candidates.
LEAST = 10
#: Rows of each language in the result, and how many bigrams lie above the first threshold.
TOP, FIRST_FRONTIER, GROWTH = 2000, 4000, 8
#: Size of a bit table (2 MB), of the texts that a task combines before it sends counts, and of what it sends at once.
BITS = 24
WINDOW = 1 << 18
SENT = 20_000
#: A count above total / HEAVY is heavy: there are at most HEAVY of them, so they may be broadcast.
HEAVY = 10_000
_PIECE = byte_table(b".,;:!?\n\x0b\x0c\r")
_WORD = _PIECE | byte_table(b" \t")
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def _joined_hash(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return scrambled(first * _MULTIPLIER + then)


def _holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bits(keys: DataFrame) -> np.ndarray:
    """The bit table of ``keys`` (lang, then one column for each word): 2^BITS bits, whatever the number of keys."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = column_hashes(batch.column(0))
            for i in range(1, batch.num_columns):
                h = _joined_hash(h, column_hashes(batch.column(i)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h >> np.uint64(64 - BITS)).astype(np.int64))], ["at"])

    words = keys.mapInArrow(places, "at long").groupBy(F.shiftright("at", 6).alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


class _Words:
    """The words of a window: an id of language and word for each, whether the next word follows in its piece."""

    def __init__(self, langs: list[str], rows: np.ndarray, joined: bytes, offsets: np.ndarray):
        joined = joined.lower()  # bytes: A-Z only
        buf = np.frombuffer(joined, np.uint8)
        start, end, part = spans(buf, offsets, _WORD)
        self.size = len(start)
        if not self.size:
            return
        names, of = np.unique(np.array(langs, object)[rows], return_inverse=True)
        code, first = distinct(joined, start, end)
        self.id, ids = pd.factorize(code * len(names) + of[part])
        word, self.lang = ids // len(names), ids % len(names)
        lead = first[word]
        self.text = pa.array([joined[a:b] for a, b in zip(start[lead].tolist(), end[lead].tolist(), strict=True)], pa.binary()).cast(pa.string())
        self.names = pa.array(names.tolist(), pa.string())
        piece = np.cumsum(_PIECE[buf])[start]
        self.next = np.zeros(self.size, bool)
        self.next[:-1] = (piece[1:] == piece[:-1]) & (part[1:] == part[:-1])
        lang_hash = column_hashes(self.names)
        # the hash of (lang, word); with the next word's own hash joined on, that of (lang, word, next)
        self.bare = hashes(buf, start[lead], end[lead])
        self.hash = _joined_hash(lang_hash[self.lang], self.bare)

    def batches(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), SENT):
            part = [c[at: at + SENT] for c in columns]
            out = [self.names.take(pa.array(self.lang[part[0]])), *(self.text.take(pa.array(c)) for c in part), pa.array(counts[at: at + SENT].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, ["lang", *"abc"[: len(columns)], "n"])


def _counted(docs: DataFrame, size: int, of_words) -> DataFrame:
    """(lang, a, b, c, n): phrases of ``size`` words with their counts over all texts. ``of_words`` says where in a window they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.fill_null(batch.column(0), "und").to_pylist()
            for rows, joined, offsets in windows(batch.column(1), _PIECE, WINDOW):
                words = _Words(langs, rows, joined, offsets)
                if not words.size:
                    continue
                at = of_words(words)
                columns = [words.id[at + k] for k in range(size)]
                # ids of the parts before, then those of pairs: they stay below the square of the window's words
                known = columns[0]
                for column in columns[1:]:
                    known, _ = pd.factorize(known * (len(words.lang)) + column)
                lead = np.unique(known, return_index=True)[1]
                yield from words.batches([c[lead] for c in columns], np.bincount(known, minlength=len(lead))[known[lead]])
                del words, at, columns, known, lead
            pa.default_memory_pool().release_unused()

    names = ["lang", *"abc"[:size]]
    kinds = ", ".join(f"{c} string" for c in names)
    return docs.select("lang", "text").mapInArrow(run, f"{kinds}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def _joined_counts(rows: DataFrame, on: dict[str, str], counts: DataFrame, name: str, total: int) -> DataFrame:
    """``rows`` with the count ``n`` of ``counts`` as ``name``; ``on`` maps its keys to columns of ``rows``.

    Rows of one heavy key do not meet in one task: heavy keys are few and broadcast, and a key that is not
    heavy has few rows, as each of them stands for LEAST occurrences of it.
    """
    match = [F.col(v) == F.col(f"_{k}") for k, v in on.items()]
    keyed = counts.select(*[F.col(k).alias(f"_{k}") for k in on], "n")
    heavy = F.broadcast(keyed.filter(f"n > {total // HEAVY}").withColumnRenamed("n", "_heavy"))
    light = keyed.filter(f"n <= {total // HEAVY}").withColumnRenamed("n", "_light")
    for side in (heavy, light):
        rows = rows.join(side, match, "left").drop(*[f"_{k}" for k in on])
    return rows.withColumn(name, F.coalesce("_heavy", "_light")).drop("_heavy", "_light")


def score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^15."""
    return F.expr(f"(1000000BD * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def _small(frame: DataFrame) -> DataFrame:
    """A frame with a row for each language: broadcast where its counted size allows, else joined as Spark plans it."""
    return F.broadcast(frame) if frame.count() <= 10_000 else frame


def collocations(docs: DataFrame, top: int = TOP, frontier: int = FIRST_FRONTIER, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of every language.

    A-Z are lower-cased; texts fall into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks
    and tabs. n counts the words of the language, a the occurrences of the phrase inside pieces, overlaps
    included. Phrases with a >= ``least`` are candidates. A phrase counts by its weakest cut (score, l, r; of equal
    cuts the first). Dropped are candidates that lie inside a longer candidate that occurs at least half as often. Order: score,
    then a, both descending, then the phrase by its bytes.

    A null text is empty, a null language ``und``; repeated rows count each time; an empty table or one
    without candidates gives no row. Texts are read whole, in windows that end with a piece.
    """
    spark = docs.sparkSession
    counted = _counted(docs, 1, lambda w: np.arange(w.size))
    kept = cut(counted.groupBy("lang", F.when(F.col("n") >= least, F.col("a")).alias("a")).agg(F.sum("n").alias("n")))
    sizes = cut(kept.groupBy("lang").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words = kept.filter("a is not null")
    frequent = spark.sparkContext.broadcast(_bits(words.select("lang", "a")))

    def pairs_of(w: _Words) -> np.ndarray:
        able = _holds(frequent.value, w.hash)[w.id]
        return np.flatnonzero(w.next[:-1] & able[:-1] & able[1:])

    pairs = cut(_counted(docs, 2, pairs_of).filter(F.col("n") >= least))
    bigrams = _joined_counts(pairs, {"lang": "lang", "a": "a"}, words, "l", total)
    bigrams = _joined_counts(bigrams, {"lang": "lang", "a": "b"}, words, "r", total)
    bigrams = cut(bigrams.withColumn("score", score("n", "l", "r")).withColumn("bound", F.expr("1000000BD * n div l")))

    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    open_langs, results = sizes.select("lang"), []
    while True:
        ranked = bigrams.join(_small(open_langs), "lang", "left_semi").select("lang", "score").withColumn("place", F.row_number().over(order))
        limits = ranked.filter(F.col("place") <= frontier).groupBy("lang").agg(F.count("*").alias("size"), F.min("score").alias("least"))
        limits = cut(limits.select("lang", F.when(F.col("size") < frontier, 0).otherwise(F.col("least")).cast("long").alias("limit")))
        grown = bigrams.join(_small(limits), "lang")
        tables = [_bits(d.select("lang", "a", "b")) for d in (bigrams, grown.filter("bound >= limit"), grown.filter("score >= limit"))]
        held = spark.sparkContext.broadcast(tables)

        def triples_of(w: _Words, held=held) -> np.ndarray:
            at = np.flatnonzero(w.next[:-2] & w.next[1:-1])
            pair = [_joined_hash(w.hash[w.id[at + k]], w.bare[w.id[at + k + 1]]) for k in (0, 1)]
            exists, prefix, suffix = held.value
            able = _holds(exists, pair[0]) & _holds(exists, pair[1])
            return at[able & (_holds(prefix, pair[0]) | _holds(suffix, pair[1]))]

        triples = cut(_counted(docs, 3, triples_of).filter(F.col("n") >= least))
        longer = triples.select("lang", "n", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"))
        longer = longer.groupBy("lang", "p.a", "p.b").agg(F.max("n").alias("most"))
        alive = grown.filter("score >= limit").join(longer, ["lang", "a", "b"], "left").filter("most is null or 2 * most < n")
        parts = triples
        for on, counts, name in (({"lang": "lang", "a": "a"}, words, "l1"), ({"lang": "lang", "a": "b", "b": "c"}, pairs, "r1"),
                                 ({"lang": "lang", "a": "a", "b": "b"}, pairs, "l2"), ({"lang": "lang", "a": "c"}, words, "r2")):
            parts = _joined_counts(parts, on, counts, name, total)
        parts = parts.withColumn("s1", score("n", "l1", "r1")).withColumn("s2", score("n", "l2", "r2"))
        parts = parts.selectExpr(
            "lang", "concat_ws(' ', a, b, c) phrase", "n a", "if(s1 <= s2, l1, l2) l", "if(s1 <= s2, r1, r2) r", "least(s1, s2) score")
        parts = parts.join(_small(limits), "lang").filter("score >= limit").drop("limit")
        found = cut(alive.selectExpr("lang", "concat_ws(' ', a, b) phrase", "n a", "l", "r", "score").unionByName(parts))
        # a language is settled when its list is full, or when nothing is left to grow
        full = found.groupBy("lang").agg(F.count("*").alias("size"))
        state = cut(limits.join(full, "lang", "left").selectExpr("lang", f"limit = 0 or coalesce(size, 0) >= {top} as settled"))
        results.append(found.join(_small(state.filter("settled").select("lang")), "lang", "left_semi"))
        open_langs = state.filter("not settled").select("lang")
        if open_langs.isEmpty():
            break
        frontier *= GROWTH
    every = results[0]
    for part in results[1:]:
        every = every.unionByName(part)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
