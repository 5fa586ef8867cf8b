"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are labelled texts, one of each group of near copies. Terms are the words that the labels of the examples depend on (likelihood
ratio tests at a bounded share of false discoveries), and one term for all other words, so that a single
telling word in a long text weighs less than many. Their document frequencies come from all texts. The index
lists, for every term, the examples that hold it in blocks of ``BLOCK`` with the largest weight of each block. A text
visits blocks in the order of the sum of these maxima, an upper bound of the cosine, until no block left can reach its
k-th nearest example: the neighbours, ties with the k-th included, are those of an exhaustive search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .tables import cut
from .windows import byte_table, hashes, scrambled, spans, windows

#: Labelled texts of each class that the index holds, drawn by hash of the text.
SAMPLE_PER_CLASS = 4000
#: Terms of the index at most, those on which the labels depend most.
VOCABULARY = 50_000
#: Examples that must hold a term before it is tested, and the share of false discoveries among the chosen terms.
LEAST_EXAMPLES, LEVEL = 4, 0.05
#: A telling term changes the odds of its examples' labels by this factor or more, up or down.
LEAST_ODDS = 4.0
NEIGHBOURS = 15
BLOCK = 64
WINDOW = 1 << 20
#: A text is toxic from this score on.
THRESHOLD = 0.7
#: Words of a shingle, and seeds of the hashes that tell near copies among the examples.
SHINGLE = 5
SKETCHES = (0x1F83D9AB, 0x5BE0CD19, 0x9B05688C, 0x510E527F)
#: Cosines that agree to so many places are ties.
PLACES = 12
_APART = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def learnable(key: str = "doc_id"):
    """Rows whose labels may teach: their remainder of crc32 by 3 is not 1 (a null key never teaches)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) != 1


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash of the word) of the words of all rows; a long text comes in several parts."""
    for rows, joined, offsets in windows(column, _APART, WINDOW):
        buf = np.frombuffer(joined, np.uint8)
        start, end, part = spans(buf, offsets, _APART)
        yield rows[part], hashes(buf, start, end)


class Lookup:
    """Places of hashes in a sorted vocabulary; a table of their first bits turns most words away."""

    def __init__(self, vocabulary: np.ndarray):
        self.sorted = vocabulary
        self.first = np.zeros(1 << 20, bool)
        self.first[(vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) by row, then term; the term behind the vocabulary stands for all other words."""
        size = len(self.sorted)
        keys, words = [np.zeros(0, np.int64)], np.zeros(len(column), np.int64)
        for row, h in _terms(column):
            words += np.bincount(row, minlength=len(words))
            near = np.flatnonzero(self.first[(h >> np.uint64(44)).astype(np.int64)])
            row, h = row[near], h[near]
            at = np.minimum(np.searchsorted(self.sorted, h), max(size - 1, 0))
            hit = self.sorted[at] == h if size else np.zeros(len(h), bool)
            keys.append(row[hit] * (size + 1) + at[hit])
        key = np.concatenate(keys)
        words -= np.bincount(key // (size + 1), minlength=len(words))
        key, count = np.unique(key, return_counts=True)
        rest = np.flatnonzero(words)
        key, count = np.concatenate([key, rest * (size + 1) + size]), np.concatenate([count, words[rest]])
        order = np.argsort(key)
        return key[order] // (size + 1), key[order] % (size + 1), count[order]


@dataclass
class Index:
    """Examples by number; posting lists by term, cut into blocks of BLOCK examples."""

    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray  # of each, then of the term for all other words
    keys: np.ndarray  # a key of each example
    labels: np.ndarray
    term_blocks: np.ndarray  # where the blocks of each term start
    block: np.ndarray  # number of each listed block: examples block * BLOCK and on
    top: np.ndarray  # its largest weight
    begin: np.ndarray  # where its postings start
    example: np.ndarray
    weight: np.ndarray
    stands: np.ndarray  # of label 0 and 1: labelled texts for each example, for the calibration
    slope: float = 0.0
    offset: float = 0.0
    bare: float = 0.5  # the score of texts without words

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (above 0) and those that tie with the last, nearest first, and their cosines."""
        listed = [np.arange(self.term_blocks[t], self.term_blocks[t + 1]) for t in terms]
        size = np.array([len(x) for x in listed])
        entry = np.concatenate(listed)
        q = np.repeat(weights, size)
        blocks, of = np.unique(self.block[entry], return_inverse=True)
        bound = np.bincount(of, weights=q * self.top[entry], minlength=len(blocks))
        rank = np.empty(len(blocks), np.int64)
        order = np.argsort(-bound, kind="stable")
        rank[order] = np.arange(len(blocks))
        visit = np.argsort(rank[of], kind="stable")  # entries by the rank of their block, then by term
        stops = np.searchsorted(rank[of][visit], np.arange(len(blocks) + 1))
        best, score = np.zeros(0, np.int64), np.zeros(0)
        done, step, least = 0, 4, -1.0
        while done < len(blocks):
            # rounding may put a bound a hair below a cosine
            if bound[order[done]] * (1 + 1e-9) + 1e-11 < least:
                break
            then = min(done + step, len(blocks))
            now = visit[stops[done]: stops[then]]
            first, count = self.begin[entry[now]], self.begin[entry[now] + 1] - self.begin[entry[now]]
            ends = np.cumsum(count)
            posts = np.arange(ends[-1]) + np.repeat(first - (ends - count), count)
            seen, which = np.unique(self.example[posts], return_inverse=True)
            cosine = np.round(np.bincount(which, weights=self.weight[posts] * np.repeat(q[now], count)), PLACES)
            if but >= 0:
                cosine, seen = cosine[seen != but], seen[seen != but]
            best, score = np.concatenate([best, seen]), np.concatenate([score, cosine])
            if len(score) >= k:
                least = np.partition(score, len(score) - k)[-k]
                best, score = best[score >= least], score[score >= least]
            done, step = then, step * 2
        order = np.lexsort((best, -score))
        return best[order], score[order]

    def vote(self, found: np.ndarray, cosine: np.ndarray, k: int = NEIGHBOURS) -> float:
        """The share of label 1 among the k nearest, weighted by cosine; those that tie for the last places share them."""
        w = cosine.copy()
        if len(w) > k:
            last = cosine == cosine[k - 1]
            w[last] *= (k - (cosine > cosine[k - 1]).sum()) / last.sum()
        return float(w @ self.labels[found] / w.sum())

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -60, 60))))


def build_index(vocabulary: np.ndarray, df: np.ndarray, n_docs: int, keys: np.ndarray, labels: np.ndarray,
                example: np.ndarray, term: np.ndarray, count: np.ndarray, shares: np.ndarray) -> Index:
    """Index and calibration over examples; postings (example, term, count) come by example, then term."""
    idf = np.append(1 + np.log((n_docs + 1) / (df + 1)), 1.0)  # the last term is every text's
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(example, weights=weight * weight, minlength=len(keys)))
    weight = weight / norm[example]
    # examples of one main term are neighbours, so that the largest weights of a block are near its others
    main = np.full(len(keys), len(vocabulary) + 1)
    strong = np.lexsort((term, -weight, example))
    lead = strong[np.flatnonzero(np.diff(example[strong], prepend=-1))]
    main[example[lead]] = term[lead]
    peak = np.zeros(len(keys))
    peak[example[lead]] = weight[lead]
    order = np.lexsort((keys, -peak, main))
    number = np.empty(len(keys), np.int64)
    number[order] = np.arange(len(keys))
    example = number[example]
    by = np.lexsort((example, term))
    example, term, weight, count = example[by], term[by], weight[by], count[by]
    cell = term * (len(keys) // BLOCK + 1) + example // BLOCK
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    index = Index(
        vocabulary, idf, keys[order], labels[order], np.searchsorted(term[begin], np.arange(len(vocabulary) + 2)), example[begin] // BLOCK,
        np.maximum.reduceat(weight, begin) if len(begin) else np.zeros(0), np.append(begin, len(example)), example, weight, shares)
    _calibrate(index, example, term, weight)
    return index


def _calibrate(index: Index, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
    """Logistic calibration of the votes that examples get from the others; examples without words give ``bare``."""
    by = np.lexsort((term, example))
    cuts = np.searchsorted(example[by], np.arange(len(index.keys) + 1))
    votes, plain = np.full(len(index.keys), np.nan), []
    for i in range(len(index.keys)):
        own = by[cuts[i]: cuts[i + 1]]
        if not len(own):
            continue
        if len(own) == 1 and term[own[0]] == len(index.vocabulary):
            plain.append(i)  # equal vectors: all others of them share the places
            continue
        found, cosine = index.nearest(term[own], weight[own], NEIGHBOURS, i)
        if len(found):
            votes[i] = index.vote(found, cosine)
    if len(plain) > NEIGHBOURS:
        own = index.labels[plain]
        votes[plain] = (own.sum() - own) / (len(own) - 1)
    else:
        for i in plain:
            found, cosine = index.nearest(term[by[cuts[i]: cuts[i + 1]]], weight[by[cuts[i]: cuts[i + 1]]], NEIGHBOURS, i)
            if len(found):
                votes[i] = index.vote(found, cosine)
    stands = index.stands[index.labels]
    alone = np.isnan(votes)
    total = stands.sum()
    share = (stands * index.labels).sum() / total if total else 0.5
    # one text of the overall mix keeps shares off 0 and 1
    index.bare = float(((stands * index.labels)[alone].sum() + share) / (stands[alone].sum() + 1))
    y, v, s = index.labels[~alone], votes[~alone], stands[~alone]
    share = ((s * y).sum() + share) / (s.sum() + 1)
    slope, offset = 0.0, float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    for _ in range(50):  # Newton steps; a weak prior keeps the slope finite where the votes tell the classes apart
        p = 1 / (1 + np.exp(-np.clip(slope * v + offset, -60, 60)))
        d, e = s * (p - y), s * p * (1 - p)
        grad = np.array([(d * v).sum() + 0.01 * slope, d.sum() + 0.01 * offset])
        hess = np.array([[(e * v * v).sum() + 0.01, (e * v).sum()], [(e * v).sum(), e.sum() + 0.01]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-8:
            break
    index.slope, index.offset = float(slope), float(offset)


def _marked(column: str = "text"):
    return F.xxhash64(column)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark, sketch): the smallest of SKETCHES hashes over the five-word shingles of a text; texts of fewer words take their mark."""
    for batch in batches:
        marks = batch.column(1).to_numpy(zero_copy_only=False)
        least = np.full((batch.num_rows, len(SKETCHES)), np.iinfo(np.uint64).max, np.uint64)
        for row, h in _terms(batch.column(2)):
            if len(h) < SHINGLE:
                continue
            rolled = h[: len(h) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k: len(h) - SHINGLE + 1 + k]
            whole = row[: len(rolled)] == row[SHINGLE - 1:]
            of, rolled = row[: len(rolled)][whole], rolled[whole]
            if len(of):
                first = np.flatnonzero(np.diff(of, prepend=-1))
                for j, seed in enumerate(SKETCHES):
                    least[of[first], j] = np.minimum(least[of[first], j], np.minimum.reduceat(scrambled(rolled ^ np.uint64(seed)), first))
        short = least[:, 0] == np.iinfo(np.uint64).max
        least[short] = marks[short].view(np.uint64)[:, None]
        flat = pa.FixedSizeListArray.from_arrays(pa.array(least.view(np.int64).ravel()), len(SKETCHES)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["id", "mark", "sketch"])


def _examples(docs: DataFrame, labels: DataFrame, key: str, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(mark, key, label) of the drawn texts, at most about ``per_class`` of each label, and how many labelled texts there are.

    Of near copies one stays, or their words would pass for telling ones: texts that share the smallest hash of their
    shingles are one, for each of SKETCHES hashes in turn.
    """
    marks = labels.select(F.col(key).alias("id"), F.col(column).cast("int").alias("y")).filter(learnable("id") & F.col("y").isin(0, 1))
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    known = docs.filter(learnable(key) & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("id"), _marked().alias("mark"), "text")
    taught = known.mapInArrow(_sketches, "id long, mark long, sketch array<long>").distinct()
    # equal texts are one example; equal texts of different labels are none
    texts = taught.join(marks, "id").groupBy("mark").agg(F.min("id").alias("id"), F.min("y").alias("y"), F.max("y").alias("most"), F.min("sketch").alias("sketch"))
    texts = texts.filter("y = most").drop("most")
    for j in range(len(SKETCHES)):
        texts = texts.groupBy(F.col("sketch")[j].alias("s")).agg(F.min(F.struct("mark", "id", "y", "sketch")).alias("x")).select("x.*")
    texts = cut(texts.drop("sketch"))
    counts = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("y") == 1, F.lit(per_class / max(counts.get(1, 1), 1))).otherwise(F.lit(per_class / max(counts.get(0, 1), 1)))
    return texts.filter(draw < limit), counts


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, term, n) of every text: its different words and how often they occur."""
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64)), *_terms(batch.column(1))]
        rows, h = (np.concatenate(c) for c in zip(*parts, strict=True))
        counts = pd.DataFrame({"row": rows, "term": h}).value_counts(sort=False).reset_index()
        yield pa.RecordBatch.from_arrays([
            pa.array(marks[counts["row"].to_numpy()]), pa.array(counts["term"].to_numpy().view(np.int64)), pa.array(counts["count"].to_numpy(np.int64))], ["mark", "term", "n"])


def _chosen_terms(lists: DataFrame, examples: DataFrame, total: int, toxic: int) -> np.ndarray:
    """Sorted terms on whose presence the labels of the examples depend, by the likelihood ratio (G) test.

    Of the terms of smallest p, as many as keep the expected share of false ones at LEVEL (step-up rule).
    """
    counted = lists.join(F.broadcast(examples.select("mark", "y")), "mark").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    counted = cut(counted.filter(F.col("n") >= LEAST_EXAMPLES))
    tests = counted.count()
    cells = [("t", toxic, "n"), ("n - t", total - toxic, "n"), (f"{toxic} - t", toxic, f"{total} - n"), (f"{total - toxic} - n + t", total - toxic, f"{total} - n")]
    terms = [f"coalesce(({o}) * ln(({o}) * {float(total)} / ({float(c)} * ({r}))), 0)" for o, c, r in cells]
    odds = F.expr(f"ln((t + 0.5) * ({total - toxic} - n + t + 0.5) / ((n - t + 0.5) * ({toxic} - t + 0.5)))")
    scored = counted.filter(F.abs(odds) >= log(LEAST_ODDS)).select("term", F.expr(f"2 * ({' + '.join(terms)})").alias("g"))
    best = scored.orderBy(F.desc("g"), "term").limit(VOCABULARY).toPandas()
    p = np.array([erfc(sqrt(max(g, 0.0) / 2)) for g in best["g"]])
    passed = np.flatnonzero(p <= LEVEL * np.arange(1, len(p) + 1) / max(tests, 1))
    kept = best["term"].to_numpy(np.int64)[: passed[-1] + 1 if len(passed) else 0]
    return np.sort(kept.view(np.uint64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Index:
    """The index of about ``per_class`` labelled texts of each class; frequencies of its terms count all of ``docs``.

    Labels teach only where the key's crc32 remainder by 3 is not 1. Labels other than 0 and 1 are ignored, a
    key or a text with both has no label, and equal texts are one example. Without examples every score is 0.5;
    without terms on which their labels depend, texts with words share one score, near the share of label 1.
    Keys must be whole numbers.
    """
    drawn, counts = _examples(docs, labels, key, column, per_class)
    examples = cut(drawn)  # about 2 * per_class rows: the sample's own bound
    kept = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(kept.values())
    shares = np.array([counts.get(y, 0) / max(kept.get(y, 0), 1) for y in (0, 1)])
    taught = docs.filter(learnable(key) & F.col("text").isNotNull()).select(_marked().alias("mark"), "text")
    taught = taught.join(F.broadcast(examples.select("mark")), "mark").select("mark", "text")
    # copies of one text give equal lists: one of each stays
    lists = cut(taught.mapInArrow(_term_lists, "mark long, term long, n long").distinct())
    vocabulary = _chosen_terms(lists, examples, total, kept.get(1, 0)) if total else np.zeros(0, np.uint64)
    rows = examples.orderBy("mark").toPandas()
    marks = rows["mark"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(Lookup(vocabulary))  # at most VOCABULARY hashes

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(held.value.sorted), np.int64)
        size = 0
        for batch in batches:
            _, term, _ = held.value.counts(batch.column(0))
            seen += np.bincount(term, minlength=len(seen) + 1)[:-1]
            size += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], size))], ["term", "n"])

    df, n_docs = np.zeros(len(vocabulary), np.int64), 0
    if len(vocabulary):
        got = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        got = dict(zip(got["term"].tolist(), got["n"].tolist(), strict=True))
        n_docs = got.pop(-1, 0)
        df[list(got)] = list(got.values())
    chosen = docs.sparkSession.createDataFrame(pd.DataFrame({"term": vocabulary.view(np.int64)}), "term long")
    # the vocabulary's words of the examples, and how many others they have; a null among hashes would make pandas round them
    known = lists.join(F.broadcast(chosen.withColumn("known", F.lit(True))), "term", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    posts = known.groupBy("mark", "known", F.when(F.col("known"), F.col("term")).otherwise(F.lit(0)).alias("term")).agg(F.sum("n").alias("n")).toPandas()
    own = posts["known"].to_numpy(bool)
    term = np.where(own, np.searchsorted(vocabulary, posts["term"].to_numpy(np.int64).view(np.uint64)), len(vocabulary))
    example = np.searchsorted(marks, posts["mark"].to_numpy(np.int64))
    return build_index(vocabulary, df, n_docs, rows["id"].to_numpy(np.int64), rows["y"].to_numpy(np.int64), example, term, posts["n"].to_numpy(np.int64), shares)


def toxicity_scores(docs: DataFrame, index: Index, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted, neighbours, cosines) of every row, from its whole ``text``.

    ``neighbours`` holds the keys of the NEIGHBOURS nearest examples, nearest first, with their ``cosines``; examples that
    tie with the last all vote, and those of smaller number in the index are listed. A text without words (a null, empty
    or blank one) has none and takes the score of such examples. ``predicted`` is 1 from THRESHOLD on. Null
    and repeated keys keep their rows. Nothing is shuffled; long texts are read in windows.
    """
    held = docs.sparkSession.sparkContext.broadcast((Lookup(index.vocabulary), index))  # bounded by the sample and VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, index = held.value
        plain = None  # of texts that hold no word of the vocabulary: their vectors are equal
        for batch in batches:
            row, term, count = lookup.counts(batch.column(1))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            score = np.full(batch.num_rows, index.bare)
            near: list[list] = [[] for _ in range(batch.num_rows)]
            cosines: list[list] = [[] for _ in range(batch.num_rows)]
            for i in range(batch.num_rows):
                own = slice(cuts[i], cuts[i + 1])
                if cuts[i] < cuts[i + 1] and len(index.keys):
                    bare = term[cuts[i]] == len(index.vocabulary)
                    if not (bare and plain):
                        found, cosine = index.nearest(term[own], index.vector(term[own], count[own]), NEIGHBOURS)
                        answer = index.score(index.vote(found, cosine)) if len(found) else index.bare, index.keys[found[:NEIGHBOURS]].tolist(), cosine[:NEIGHBOURS].tolist()
                        plain = answer if bare else plain
                    score[i], near[i], cosines[i] = plain if bare else answer
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], [key, "score", "neighbours", "cosines"])

    schema = StructType([docs.schema[key], StructField("score", DoubleType()), StructField("neighbours", ArrayType(LongType())), StructField("cosines", ArrayType(DoubleType()))])
    scored = docs.select(key, "text").mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
