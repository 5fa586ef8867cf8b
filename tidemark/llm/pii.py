"""Personal data: four base kinds by pattern, and further identifiers by bootstrapped contexts.

The base spans of each text come from fixed patterns. They also seed a graph: a lexical pattern is the
word, or the two words, before a mention; its instances are the identifiers that follow it. Spark scores
both in turns. A pattern's confidence in a kind is the share of its occurrences that lead to instances of
that kind, where an identifier of the kind's form that is not known yet weighs half against it; an unknown identifier's confidence is that of its best pattern, and identifiers found by
confident patterns count in the next turn, as support of further patterns too. Turns end when none finds anything new.
Accepted mentions become further spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, free_names
from .text import chunks

KINDS = ("email", "ip", "card", "phone")
#: Different known instances that a pattern needs, and the confidence from which it extracts.
SUPPORT, CONFIDENCE = 5, 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MENTION = re.compile(r"[0-9@]\S*")
#: Groups of digits around single blanks, the first perhaps in brackets; the groups behind are joined in one way.
_SPACED = re.compile(
    r"(?<![^\s\"'<\[{(])(?:\([0-9]{1,5}\)|[0-9]{1,6}) [0-9]{2,6}(?:(?: [0-9]{2,6})+|(?:-[0-9]{2,6})+|(?:\.[0-9]{2,6})+)?(?![0-9A-Za-z@]|[-.][0-9A-Za-z])")
_BEFORE = re.compile(r"(?:(\S+)\s+)?(\S+)\s+$")
_GAP = re.compile(r"\s")
#: Which identifiers a context may turn into a kind; a fixed rule of form for each kind.
_FORMS = {
    "email": re.compile(r"[^@\s]+@[^@\s]+"), "ip": re.compile(r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}"),
    "card": re.compile(r"(?:[0-9][ -]?){12,18}[0-9]"), "phone": re.compile(r"\(?[0-9](?:[().0-9-]| (?! )){5,}[0-9]"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each character looked at once: the local part is the run before an @, behind the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost without overlap per kind, by kind and start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    digits = list(_DIGITS.finditer(text))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
    for m in digits:
        if m.end() - m.start() >= 13:
            bare = m.group().replace(" ", "").replace("-", "")
            if len(bare) <= 19 and len(bare) >= 13 and _luhn(bare):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in "\"'<[{(":
        start += 1
    while start < end and text[end - 1] in ".,;:!?\"'>]})":
        end -= 1
    return start, end


def _others(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Words with a digit or an @ outside the base spans, without enclosing marks; numbers that span single blanks are one."""
    held = sorted((a, b) for _, a, b in taken)
    spaced = [m.span() for m in _SPACED.finditer(text) if 7 <= sum(c.isdigit() for c in m.group()) <= 19]
    i, j, reach = 0, 0, 0
    for m in _MENTION.finditer(text):
        if m.start() < reach:
            continue
        start = m.start()
        while start > reach and not text[start - 1].isspace():
            start -= 1
        reach = m.end()
        start, end = _trimmed(text, start, m.end())
        while j < len(spaced) and spaced[j][1] <= m.start():
            j += 1
        whole = j < len(spaced) and spaced[j][0] <= m.start()
        if whole:
            start, end = spaced[j]
        while i < len(held) and held[i][1] <= start:
            i += 1
        if whole and any(a < end and b > start for a, b in held[i: i + 4]):  # a base span within: its words one by one
            whole = False
            start, end = _trimmed(text, m.start(), m.end())
        if whole:
            reach = max(reach, end)
        if end - start >= 3 and not any(a < end and b > start for a, b in held[i: i + 4]):
            yield start, end


def _named(words: str) -> str:
    """A text that stands for ``words``: itself, or for long ones their start and a digest of the whole."""
    if len(words) <= 64:
        return words
    return f"{words[:32]}#{blake2b(words.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def _patterns(text: str, start: int) -> list[str]:
    """The word, and the two words, before a position, lower-cased with their marks."""
    reach, found = 140, None
    while True:  # as far back as two whole words need
        low = max(0, start - reach)
        found = _BEFORE.search(text, low, start)
        if low == 0 or found and found.group(1) and found.start(1) > low:
            break
        reach *= 8
    if not found:
        return []
    two, one = found.group(1), found.group(2).lower()
    return [_named(one), *([_named(f"{two.lower()} {one}")] if two else [])]


def _forms(word: str) -> list[str]:
    blank = " " in word  # more than 15 digits in groups are no phone number
    return [k for k in KINDS if _FORMS[k].fullmatch(word) and not (blank and k == "phone" and sum(c.isdigit() for c in word) > 15)]


def _read(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, joined, offsets in chunks(batch.column(2)):
                spans, edges = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = joined[a:b].decode()
                    # a text without digits and @ holds no mention of any kind
                    base = base_spans(text) if _MENTION.search(text) else []
                    spans.append([{"kind": KINDS.index(k), "start": s, "end": e} for k, s, e in base])
                    edges.append(list(_edges(text, base)) if base or "@" in text or _MENTION.search(text) else [])
                span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
                edge = pa.list_(pa.struct([("pattern", pa.string()), ("kind", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()),
                                           ("start", pa.int32()), ("end", pa.int32()), ("seen", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(spans, span), pa.array(edges, edge)],
                    [key, "mark", "base", "edges"])

    return run


def _edges(text: str, base: list[tuple[str, int, int]]) -> Iterator[dict]:
    """Mentions with their patterns; ``seen``: how often the pattern's words stand in this text, on its first edge."""
    mentions = [(s, e, (k,), True) for k, s, e in base]
    mentions += [(s, e, kinds, False) for s, e in _others(text, base) if (kinds := _forms(text[s:e]))]
    if not mentions:
        return
    out = [(p, k, s, e, seed) for s, e, kinds, seed in mentions for p in _patterns(text, s) for k in kinds]
    wanted = {p for p, *_ in out}
    if not wanted:
        return
    words = text.lower().split()
    seen = dict.fromkeys(wanted, 0)
    for w in words:
        if len(w) > 64:
            w = _named(w)
        if w in seen:
            seen[w] += 1
    for w in zip(words, words[1:]):
        p = " ".join(w)
        if len(p) > 64:
            p = _named(p)
        if p in seen:
            seen[p] += 1
    for p, n in Counter(p for p, *_ in {(p, s) for p, _, s, *_ in out}).items():
        seen[p] = max(seen[p], n)
    for p, k, s, e, seed in out:
        yield {"pattern": p, "kind": KINDS.index(k), "instance": _named(text[s:e].lower()), "seed": seed, "start": s, "end": e, "seen": seen[p]}
        seen[p] = 0


def bootstrap(read: DataFrame, key: str) -> DataFrame:
    """Accepted further mentions (key, mark, kind, start, end) of the documents in ``read``."""
    edges = cut(read.select(key, "mark", F.explode("edges").alias("e")).select(key, "mark", "e.*"))
    total = edges.groupBy("pattern").agg(F.sum("seen").alias("seen"))
    graph = cut(edges.groupBy("pattern", "kind", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    # a pattern with too few instances of a kind, known or not, or too few among its places can never become confident
    able = graph.groupBy("pattern", "kind").agg(F.count("*").alias("instances"), F.sum("n").alias("places")).join(total, "pattern").filter(
        (F.col("instances") >= SUPPORT) & (F.col("places") >= CONFIDENCE * F.col("seen"))).select("pattern", "kind", "seen")
    seeds = cut(graph.filter("seed").select("kind", "instance", F.lit(1.0).alias("belief")).distinct())
    graph = cut(graph.join(able, ["pattern", "kind"]))
    known, before, belief = seeds, None, F.coalesce("belief", F.lit(0.0))
    while True:  # beliefs only grow from turn to turn
        rated = graph.join(known, ["kind", "instance"], "left").groupBy("pattern", "kind").agg(
            (F.sum(F.col("n") * belief) / (F.first("seen") - 0.5 * F.sum(F.col("n") * (1 - belief)))).alias("confidence"), F.count("belief").alias("support"))
        sure = cut(rated.filter((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)))
        found = graph.filter("not seed").join(sure, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.least(F.lit(1.0), F.max("confidence")).alias("belief"))
        known = cut(found.union(seeds.select("kind", "instance", "belief")).groupBy("kind", "instance").agg(F.max("belief").alias("belief")))
        after = known.agg(F.count("*"), F.round(F.sum("belief"), 3)).first(), sure.count()
        if after == before:
            break
        before = after
    accepted = edges.filter("not seed").join(sure.select("pattern", "kind"), ["pattern", "kind"])
    # one kind for each place, the first that a pattern supports
    return accepted.groupBy(key, "mark", "start", "end").agg(F.min("kind").alias("kind"))


def find_pii(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, mark, base, further) of every row of ``docs``: arrays of (kind, start, end) sorted by kind and start.

    ``kind`` is a position in KINDS, places are code points with the end exclusive, ``base`` holds the
    pattern matches and ``further`` those that contexts add, which never overlap base spans. ``mark`` is a hash of
    the text. A null or empty text has no spans; null and repeated keys pass through, one row each. The
    text is read once; afterwards only mentions and contexts move.
    """
    marked = docs.select(key, F.xxhash64("text").alias("mark"), "text")
    kind = docs.schema[key].dataType.simpleString()
    read = cut(marked.mapInArrow(_read(key), (
        f"`{key}` {kind}, mark long, base array<struct<kind:int,start:int,end:int>>, "
        "edges array<struct<pattern:string,kind:int,instance:string,seed:boolean,start:int,end:int,seen:int>>")))
    more = bootstrap(read, key).groupBy(F.col(key).alias("_key"), F.col("mark").alias("_mark")).agg(
        F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("further"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    joined = read.select(key, "mark", "base").join(more, F.col(key).eqNullSafe(F.col("_key")) & (F.col("mark") == F.col("_mark")), "left")
    return joined.select(key, "mark", "base", F.coalesce("further", none).alias("further"))


def span_text(spans):
    """kind:start:end of an array of spans, by kind and start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets (overlapping spans by the first), ``n_chars`` counted anew.

    A null text stays null. Columns, their order and rows stay; only ``text`` and ``n_chars`` (where there is one) change.
    """
    names = docs.columns
    at = names.index("text")
    found = find_pii(docs, key)
    other, mark, more_ = free_names(docs, "key_", "mark_", "more_")
    spans = found.filter(F.size("further") > 0).groupBy(F.col(key).alias(other), F.col("mark").alias(mark)).agg(F.first("further").alias(more_))
    joined = docs.join(spans, F.col(key).eqNullSafe(F.col(other)) & (F.xxhash64("text") == F.col(mark)), "left").select(*names, more_)
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            more = columns.pop()
            for first in range(0, batch.num_rows, 512):
                part = [c.slice(first, 512) for c in columns]
                texts = part[at].to_pylist()
                for i, (text, extra) in enumerate(zip(texts, more.slice(first, 512).to_pylist(), strict=True)):
                    if text:
                        every = [(s, e, k) for k, s, e in base_spans(text)] + [(x["start"], x["end"], KINDS[x["kind"]]) for x in extra or ()]
                        if every:
                            pieces, done = [], 0
                            for s, e, k in sorted(every):
                                if s >= done:
                                    pieces += [text[done:s], f"[{k}]"]
                                done = max(done, e)
                            texts[i] = "".join([*pieces, text[done:]])
                part[at] = pa.array(texts, columns[at].type)
                if size is not None:
                    part[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[size].type)
                yield pa.RecordBatch.from_arrays(part, names)

    return joined.mapInArrow(run, docs.schema)
