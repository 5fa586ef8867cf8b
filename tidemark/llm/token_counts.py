"""Token counts without ids: pieces once per distinct pre-token, joined to document frequencies.

A task turns its chunk of documents (a block) into pre-token frequencies: one row per distinct pre-token
of the block, with its frequency in each document of the block packed behind it. Pre-tokens that the
vocabulary holds whole are added up at once from a table no larger than the vocabulary. The other rows
meet by pre-token, where each pre-token's pieces are counted once and multiplied into its frequencies;
sums per document travel packed by block and are added to the block's own rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import chunks, distinct, pre_tokens

#: Rows of a pre-token are dealt over so many tasks once a block holds it in more than FREQUENT documents.
SALTS, FREQUENT = 64, 64
#: Text of a block, and frequencies held before sums leave a task.
BLOCK_BYTES, PENDING = 8 << 20, 1_000_000


class Pieces:
    """Normalisation, special strings and piece counts of one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        known = [w[:-4] for w in self.tokenizer.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalnum()]
        self.whole = {w.encode() for w, n in zip(known, self.count(known), strict=True) if n == 1 and w == w.lower() and (w.isalpha() or len(w) == 1)}

    def count(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if max(text) < "ɐ" and unicodedata.is_normalized("NFC", text) and "İ" not in text:
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _frequencies(path: str, key: str, salt: str):
    """Rows of kind 0: a document of a block with its own count so far; of kind 1: a pre-token of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        task, number = TaskContext.get().partitionId(), -1
        for batch in batches:
            for first, end, joined, offsets in chunks(batch.column(1), BLOCK_BYTES):
                number += 1
                block = task << 32 | number
                texts = [joined[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                counts = np.zeros(end - first, np.int64)
                parts, owner = [], []  # stretches between special strings, and their documents
                for i, text in enumerate(texts):
                    found = own.special.split(text) if own.special else [text]
                    counts[i] = len(found) - 1
                    parts += map(own.normal, found)
                    owner += [i] * len(found)
                sizes = [len(p.encode()) for p in parts]
                clean = "".join(parts).encode()
                start, stop, row = pre_tokens(clean, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), spaced=False)
                tokens: list[bytes] = []
                packs: list[bytes] = []
                salts: list[int] = []
                if len(start):
                    code, lead = distinct(clean, start, stop)
                    names = [clean[a:b] for a, b in zip(start[lead], stop[lead], strict=True)]
                    whole = np.fromiter((w in own.whole for w in names), bool, len(names))
                    doc = np.array(owner)[row]
                    once = whole[code]
                    counts += np.bincount(doc[once], minlength=len(counts))
                    pair, often = np.unique(code[~once] * np.int64(len(counts)) + doc[~once], return_counts=True)
                    word, doc = pair // len(counts), pair % len(counts)
                    flat = np.empty((len(pair), 2), "<u4")
                    flat[:, 0], flat[:, 1] = doc, often
                    small = flat.max(initial=0) < 1 << 16
                    flat = flat.astype("<u2") if small else flat
                    cuts = np.flatnonzero(np.diff(word, prepend=-1))
                    ends = np.append(cuts[1:], len(word))[: len(cuts)]
                    raw, width = flat.tobytes(), 4 if small else 8
                    for k, a, b in zip(word[cuts].tolist(), cuts.tolist(), ends.tolist(), strict=True):
                        tokens.append(names[k])
                        packs.append((b"s" if small else b"l") + raw[a * width: b * width])
                        salts.append((task + number) % SALTS if b - a > FREQUENT else -1)
                n, m = end - first, len(tokens)
                ids = batch.column(0).slice(first, n)
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                    pa.array(np.full(n + m, block), pa.int64()),
                    pa.array(np.concatenate([np.arange(n), np.full(m, -1)]), pa.int32()),
                    pa.array(np.concatenate([np.diff(offsets), np.zeros(m, np.int64)]), pa.int64()),
                    pa.array(np.concatenate([counts, np.zeros(m, np.int64)]), pa.int64()),
                    pa.array([None] * n + tokens, pa.binary()),
                    pa.array(np.concatenate([-2 - task * 64 - np.arange(n) % 64, np.array(salts, np.int64)]), pa.int64()),
                    pa.array([None] * n + packs, pa.binary()),
                ], [key, "block", "place", "n_bytes", "n_tokens", "token", salt, "pack"])

    return run


def _unpacked(pack: bytes) -> np.ndarray:
    return np.frombuffer(pack, "<u2" if pack[:1] == b"s" else "<u4", offset=1).astype(np.int64)


def _counted(path: str, key: str):
    """Documents pass; a pre-token has its pieces counted once, for all blocks that hold it."""

    def flush(held: dict[int, list[tuple[np.ndarray, np.ndarray]]], like: pa.DataType) -> pa.RecordBatch:
        packs = []
        for parts in held.values():
            doc, inverse = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
            flat = np.stack([doc, np.bincount(inverse, weights=np.concatenate([t for _, t in parts])).astype(np.int64)], 1)
            small = flat.max() < 1 << 16
            packs.append((b"s" if small else b"l") + flat.astype("<u2" if small else "<u4").tobytes())
        n = len(packs)
        zero = pa.array(np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, like), pa.array(list(held), pa.int64()), pa.array(np.full(n, -1, np.int32)), zero, zero, pa.array(packs, pa.binary())],
            [key, "block", "place", "n_bytes", "n_tokens", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        held: dict[int, list] = {}
        size, last, last_n, like = 0, None, 0, pa.int64()
        for batch in batches:
            like = batch.schema.field(key).type
            is_doc = pc.is_null(batch.column("token"))
            docs, rows = batch.filter(is_doc), batch.filter(pc.invert(is_doc))
            if docs.num_rows:
                yield docs.select([key, "block", "place", "n_bytes", "n_tokens", "pack"])
            if not rows.num_rows:
                continue
            coded = rows.column("token").dictionary_encode()
            names = coded.dictionary.to_pylist()
            n_of = {last: last_n}
            fresh = [w for w in names if w != last]
            n_of.update(zip(fresh, own.count([w.decode() for w in fresh]), strict=True))
            last = names[coded.indices[-1].as_py()]
            last_n = n_of[last]
            per = np.array([n_of[w] for w in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            for b, p, n in zip(rows.column("block").to_pylist(), rows.column("pack").to_pylist(), per.tolist(), strict=True):
                flat = _unpacked(p)
                held.setdefault(b, []).append((flat[0::2], flat[1::2] * n))
                size += len(flat)
            if size > PENDING:
                yield flush(held, like)
                held, size = {}, 0
        if held:
            yield flush(held, like)

    return run


def _added(key: str):
    def run(rows: pa.Table) -> pa.Table:
        is_doc = pc.greater_equal(rows.column("place"), 0)
        docs = rows.filter(is_doc)
        place = docs.column("place").to_numpy()
        extra = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        for p in rows.filter(pc.invert(is_doc)).column("pack").to_pylist():
            flat = _unpacked(p)
            np.add.at(extra, flat[0::2], flat[1::2])
        return pa.table({key: docs.column(key), "n_bytes": docs.column("n_bytes"),
                         "n_tokens": pa.array(docs.column("n_tokens").to_numpy() + extra[place])})

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """Tokens of every whole ``text`` under a tokenizer file with lower-casing, word-end BPE.

    Returns ``key``, ``n_bytes`` and ``n_tokens`` (long), one row per row of ``docs``. Strings of special
    tokens inside a text count one each, as the library does by default; none is added. A null or empty
    text counts 0 and 0; null and repeated keys pass through, one row each; other columns are ignored.
    Blocks are numbered by task, so ``docs`` should be read from a table (its tasks then repeat exactly).
    A pre-token frequent in a block is salted over SALTS tasks by block.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, "text").mapInArrow(
        _frequencies(tokenizer_path, key, "salt"),
        f"`{key}` {kind}, block long, place int, n_bytes long, n_tokens long, token binary, salt long, pack binary")
    met = rows.repartition("token", "salt").sortWithinPartitions("token")
    sums = met.mapInArrow(_counted(tokenizer_path, key), f"`{key}` {kind}, block long, place int, n_bytes long, n_tokens long, pack binary")
    return sums.groupBy("block").applyInArrow(_added(key), f"`{key}` {kind}, n_bytes long, n_tokens long")
