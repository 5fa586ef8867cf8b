import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from tidemark.llm import bpe
from tidemark.llm.tables import cut

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"


def test_stages_against_their_inputs(spark):
    from test_near_duplicates import brute_print
    from test_pii import brute

    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    first, seen = docs.columns, {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, LABELLED))
        assert name == "encode" or docs.columns == first
        seen[name] = docs.toPandas()
    labels = pq.read_table(f"{LABELLED}/labels.parquet").to_pandas()
    good, bad = set(labels[labels.quality == 1].doc_id), set(labels[labels.quality == 0].doc_id)
    kept = set(seen["quality"].doc_id)
    assert len(good - kept) <= 0.02 * len(good) and len(bad & kept) <= 0.1 * len(bad)
    # near duplicates: the smallest key of each group, and nothing else goes
    before, after = seen["quality"], set(seen["near_duplicates"].doc_id)
    f = np.array([brute_print(t) for t in before.text], np.uint64)
    order = np.argsort(before.doc_id.to_numpy())
    ids, links = before.doc_id.to_numpy()[order], np.bitwise_count(f[order][:, None] ^ f[order][None, :]) <= 3
    from test_near_duplicates import least_reachable

    assert after == set(ids[np.unique(least_reachable(links))])
    texts = dict(zip(seen["near_duplicates"].doc_id, seen["near_duplicates"].text))
    clean = seen["personal_data"]
    assert len(clean) == len(texts) and not any(brute(t) for t in clean.text)
    assert all(t == texts[i] for i, t in zip(clean.doc_id, clean.text) if not brute(texts[i]) and "[" not in t)
    mixed = seen["mix_sources"].groupby("doc_id").size()
    assert mixed.max() <= 2 and set(mixed.index) <= set(clean.doc_id)
    # every row of the mix is encoded and decodes to itself
    codec, bodies = bpe.codec(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken")), dict(zip(clean.doc_id, clean.text))
    assert seen["encode"].groupby("doc_id").size().equals(mixed)
    for row in seen["encode"].itertuples():
        ids = np.frombuffer(row.ids, "<u4")
        assert codec.decode(ids, np.array([len(ids)]))[0].tobytes().decode() == bodies[row.doc_id] and row.n_tokens == len(ids)


def test_run_gives_the_same_rows_again(spark):
    rows = [sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_stages_take_odd_rows_and_empty_tables(spark, odd_documents, no_documents):
    for frame in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, frame, SF)
            assert name == "encode" or got.columns == frame.columns
            assert (got.count() == 0) == (frame is no_documents)
