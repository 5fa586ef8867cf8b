import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import language, quality
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def offsets_of(texts):
    raw = [t.encode() for t in texts]
    return b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_quality_of_held_out_labels(spark):
    rows = QUERIES["op9_quality"](spark, SF).toPandas()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    assert len(rows) == len(docs) and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    import zlib

    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.97 and ((held.quality == 1) & (held.predicted == 0)).mean() <= 0.01


def test_machine_equals_the_sum_over_pairs():
    texts = ["one two two three", "", "ONE!! more ### words\nand lines", "ü"]
    row, bucket, value, stats = quality.features(*offsets_of(texts))
    rng = np.random.default_rng(0)
    k = quality.BUCKETS + len(quality.STATISTICS)
    machine = quality.Machine(0.3, rng.normal(size=k), rng.normal(size=(k, 4)).astype(np.float32), rng.normal(size=17), rng.uniform(1, 2, 17), 1.0, 0.0)
    got = machine.raw(row, bucket, value, stats, len(texts))
    for i in range(len(texts)):
        x = np.zeros(k)
        x[bucket[row == i]] = value[row == i]
        x[quality.BUCKETS:] = machine.standard(stats)[i]
        at = np.flatnonzero(x)
        want = 0.3 + machine.w @ x + sum(float(machine.v[a] @ machine.v[b]) * x[a] * x[b] for n, a in enumerate(at) for b in at[n + 1:])
        assert got[i] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_word_hashes_do_not_depend_on_place():
    joined, offsets = offsets_of(["abc de abc", "  de\tABC ", "", "abcde"])
    start, end, row, h = quality.words(np.frombuffer(joined, np.uint8), offsets)
    assert [joined[a:b] for a, b in zip(start, end)] == [b"abc", b"de", b"abc", b"de", b"ABC", b"abcde"]
    assert row.tolist() == [0, 0, 0, 1, 1, 3] and h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_quality_without_labels_or_of_one_class(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert quality.fit_quality(odd_documents, none).score(b"", np.array([0, 0])).tolist() == pytest.approx([0.5])
    ones = spark.createDataFrame([(i, 1, "x") for i in range(9)] + [(None, 0, "y"), (7, None, "z")], "doc_id long, quality int, text string")
    machine = quality.fit_quality(odd_documents, ones)
    scored = quality.quality_scores(odd_documents, machine, tuple(odd_documents.columns)).collect()
    assert len(scored) == 12 and {r.predicted for r in scored} == {1}
    assert quality.quality_scores(no_documents, machine).count() == 0


def test_both_classes_among_odd_rows(spark, odd_documents):
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(3, 0), (3, 1)], "doc_id long, quality int")
    scored = quality.quality_scores(odd_documents, quality.fit_quality(odd_documents, both)).collect()
    assert len(scored) == 12 and all(0 <= r.score <= 1 for r in scored)


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op4_language"](spark, SF).toPandas()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    held = rows[rows.held_out].merge(docs, on="doc_id")
    assert len(rows) == len(docs) and (held.lang_pred == held.lang).mean() >= 0.98 and rows.score.between(0, 1).all()
    assert rows[~rows.rejected].merge(docs, on="doc_id").pipe(lambda d: (d.lang_pred == d.lang).mean()) >= 0.99


def test_subwords_stay_inside_words_and_rows():
    def counts(texts):
        joined, offsets = offsets_of(texts)
        return [per.tolist() for _, per in language.subwords(joined, offsets)]

    # " ab " has two-byte runs " a", "ab", "b ", three-byte runs " ab", "ab " and one of four bytes
    assert counts(["ab"]) == [[3], [2], [1]]
    assert counts(["ab", "", "AB  ab"]) == [[3, 0, 6], [2, 0, 4], [1, 0, 2]]
    one, many = language.subwords(*offsets_of(["Äb c"])), language.subwords(*offsets_of(["x", "äb c"]))
    assert all(a[0].tolist() == b[0][b[1][0]:].tolist() for a, b in zip(one, many))


def test_language_of_odd_rows(spark, odd_documents, no_documents):
    model = language.fit_languages(odd_documents)
    rows = language.predict_languages(odd_documents, model).toPandas()
    learned = set(model.languages)
    assert len(rows) == 12 and None not in learned and set(rows.lang_pred) <= learned | {"und"}
    assert (rows[rows.doc_id.isin([2, 3, 4, 7])].lang_pred == "und").all() and (rows[rows.lang_pred == "und"].score == 0).all()
    assert language.predict_languages(no_documents, model).count() == 0
    empty = language.fit_languages(no_documents)
    assert set(language.predict_languages(odd_documents, empty).toPandas().lang_pred) == {"und"}
