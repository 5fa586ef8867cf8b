import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, text
from tidemark.llm.queries import QUERIES
from tidemark.llm.token_counts import token_counts


SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab'sstdmlrve  \n\t é1٣²_.-!\x00　\U0001F600ß\x1c\x85"


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def random_texts(n, size, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, size))) for _ in range(n)]


def test_pre_tokens_are_the_matches_of_the_pattern():
    white = r"\p{White_Space}"
    spaced = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{white}\p{{L}}\p{{N}}]+|{white}+(?!\P{{White_Space}})|{white}+")
    bare = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{white}\p{{L}}\p{{N}}]+")
    texts = random_texts(4000, 30, 1)
    for pattern, flag in ((spaced, True), (bare, False)):
        for first, end, joined, offsets in text.chunks(pa.array(texts), 200):
            got = [[] for _ in range(end - first)]
            for a, b, row in zip(*text.pre_tokens(joined, offsets, flag)):
                got[row].append(joined[a:b].decode())
            assert got == [pattern.findall(t) for t in texts[first:end]]


def test_equal_slices_share_a_code():
    joined = b"abcabcabcdefghijklmnopqrstuvwabcdefghijklmnopqrstuvw"
    start, end = np.array([0, 3, 6, 29, 0]), np.array([3, 6, 29, 52, 2])
    code, first = text.distinct(joined, start, end)
    assert code.tolist() == [0, 0, 1, 1, 2] and first.tolist() == [0, 2, 4]


def test_perfect_hash_is_minimal_and_exact():
    entries = {k: v for k, v in bpe.read_ranks(RANKS).items() if len(k) <= 16}
    table = bpe.PerfectHash.build(entries)
    assert len(table.value) == len(entries)
    keys = [*entries, b"", b"not a token", b"zzqqzzqq"]
    ends = np.cumsum([len(k) for k in keys])
    starts = ends - np.array([len(k) for k in keys])
    found = table.find(*text.packed(b"".join(keys), starts, ends), ends - starts)
    assert found.tolist() == [*entries.values(), -1, -1, -1]
    assert bpe.PerfectHash.build({}).find(np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.ones(1, np.int64)).tolist() == [-1]


def test_codec_equals_the_library(encoding):
    codec = bpe.Codec(RANKS)
    texts = [*random_texts(3000, 60, 2), "a" * 3000, "aaaa " * 99, " " * 40 + "x", "=-" * 60, "<|endoftext|>"]
    for first, end, joined, offsets in text.chunks(pa.array(texts), 5000):
        ids, counts = codec.encode(joined, offsets)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [encoding.encode_ordinary(t) for t in texts[first:end]]
        back, sizes = codec.decode(ids, counts)
        assert back.tobytes() == joined and sizes.tolist() == np.diff(offsets).tolist()


def test_memory_of_misses_turns_over(monkeypatch, encoding):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(RANKS)
    for word in (f"qz{i}xk{i % 7}" for i in range(40)):
        ids, _ = codec.encode(word.encode(), np.array([0, len(word)]))
        assert ids.tolist() == encoding.encode_ordinary(word)


def test_byte_bpe_query(spark, documents, encoding):
    rows = QUERIES["op7_byte_bpe"](spark, SF).toPandas().set_index("doc_id")
    assert len(rows) == len(documents)
    for key, body in zip(documents.doc_id, documents.text):
        ids = encoding.encode_ordinary(body or "")
        row = rows.loc[key]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((body or "").encode()).hexdigest()


def test_token_counts_query(spark, documents):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = QUERIES["op6_token_counts"](spark, SF).toPandas().set_index("doc_id")
    assert len(rows) == len(documents)
    for key, body in zip(documents.doc_id, documents.text):
        n = len(tokenizer.encode(body or "", add_special_tokens=False).ids)
        assert rows.loc[key].tolist() == [len((body or "").encode()), n, n > 2048]


def test_token_counts_of_odd_texts(spark):
    texts = [*random_texts(400, 50, 5), "İstanbul ΣΑΣ ﬁ Å é", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "thnq " * 9000, "", None]
    tokenizer = Tokenizer.from_file(WORDS)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = token_counts(frame, WORDS).toPandas().set_index("doc_id").n_tokens
    assert [rows[i] for i in range(len(texts))] == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_a_word_of_many_documents_is_salted_and_counted_alike(spark, monkeypatch):
    from tidemark.llm import token_counts as module

    monkeypatch.setattr(module, "PENDING", 50)
    tokenizer = Tokenizer.from_file(WORDS)
    want = len(tokenizer.encode("qqzzxxkk vvbbnnqq " * 2, add_special_tokens=False).ids)
    frame = spark.range(600).selectExpr("id as doc_id", "repeat('qqzzxxkk vvbbnnqq ', 2) as text").repartition(5)
    assert {r.n_tokens for r in token_counts(frame, WORDS).collect()} == {want}


def test_odd_rows_and_empty_tables(spark, odd_documents, no_documents):
    coded = bpe.byte_bpe(odd_documents, RANKS).collect()
    assert len(coded) == 12 and sorted(len(r.decoded) for r in coded)[:3] == [0, 0, 0]
    counts = token_counts(odd_documents, WORDS).collect()
    assert len(counts) == 12 and sum(r.doc_id is None for r in counts) == 4
    assert bpe.byte_bpe(no_documents, RANKS).count() == 0 and token_counts(no_documents, WORDS).count() == 0
