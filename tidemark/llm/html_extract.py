"""Main text of web pages by nearest-URL page differencing.

A page's blocks of text become lines. Pages of a host are put in the order of their URL paths, so that
the pages before and behind a page are its nearest by path. The lines of neighbouring pages are aligned
by a longest common subsequence, and lines they share are template: they are deleted. Markup is evidence
beside that: elements for navigation, headers, footers, asides, forms, notices, adverts and comments are
dropped at once, and a line of a page's article element is deleted only where both neighbours share it and
most different pages of the host carry it, so that mirrored articles and quoted passages stay.

Inside an article, ids prove nothing, and a class or role name needs a second sign: a container whose whole name is
the word; or markup that bears a longer name out (most of its text is links, it holds controls, no running text, or parts
so named or articles of its own, as comments do); or, line by line, a neighbour that shares the line.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .tables import cut

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|iframe|title)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Fixed vocabulary of HTML: elements that end a block, and elements that hold no article text.
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = frozenset("nav aside footer form dialog menu button label fieldset head object svg canvas select template".split())
#: Elements outside the article that stand within a line and do not end it.
_WITHIN = frozenset("object svg canvas select template".split())
#: Words of class, id and role names that mark parts outside the article.
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond reply replies discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget widgets copyright complementary contentinfo".split())
#: Words of class, id and role names that mark the article.
_MAIN = frozenset("article main articlebody".split())
#: Elements of running text: an id on them is an anchor; names on headings never count.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT = _HEADINGS | frozenset("p li dt dd td th blockquote pre figure figcaption section a span b i em strong".split())
_RUNNING = _HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption".split())
#: Elements that hold parts of a page.
_PARTS = frozenset("div section ul ol dl table details article".split())
_CONTROLS = frozenset("form input textarea button select".split())
#: A named part of an article goes where this share of its letters stands in links.
LINKED = 0.5
_HEADER = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:header|banner)\b", re.I)
#: The attribute without a value, outside quotes.
_HIDDEN, _QUOTED = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I), re.compile(r"\"[^\"]*\"|'[^']*'")
_WHITE = re.compile(r"[\s]+")


def _marks(attributes: str, element: str) -> tuple[bool, bool, bool, bool, bool]:
    """(named as outside by class or role, by a whole such name, by id, hidden, the article itself) by an element's attributes."""
    named = whole = by_id = hidden = main = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            if not words.isdisjoint(_NAMES) and element not in _HEADINGS:
                if name == "id":
                    by_id |= element not in _TEXT
                else:
                    named = True
                    whole |= not _NAMES.isdisjoint(value.lower().split())
            main |= value.lower() == "main" and name in ("id", "role") or value.lower() == "article" and name == "role"
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
    if "hidden" in attributes.lower() and not hidden:
        hidden = bool(_HIDDEN.search(_QUOTED.sub("", attributes)))
    return named, whole, by_id, hidden, main


#: Where a line stands: outside an article, in one, or in a part of one whose name alone puts it outside.
ELSEWHERE, ARTICLE, NAMED = 0, 1, 2


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, where it stands) of the blocks of a page that markup does not rule out, in order."""
    lines: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple] = []  # element, whether it starts a part outside, whether it starts an article, what was counted before a named part
    outside = inside = done = links = 0
    letters, linked, controls, named_parts, articles, running = 0, 0, 0, 0, 0, 0
    seen = False

    def flush() -> None:
        if held:
            text = _WHITE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                lines.append((text, ARTICLE if inside > 0 else ELSEWHERE))

    def hold(text: str) -> None:
        nonlocal letters, linked
        held.append(text)
        size = len(text) - text.count(" ")
        letters += size
        linked += size * (links > 0)

    def pop() -> None:
        nonlocal outside, inside, links
        name, out, main, before = stack.pop()
        outside -= out
        inside -= main
        links -= name == "a"
        if before:
            first, had, had_linked, had_controls, had_named, had_articles, had_running = before
            flush()
            proven = linked - had_linked >= LINKED * max(letters - had, 1) or controls > had_controls or named_parts > had_named or articles > had_articles
            proven = proven or name in _PARTS and running == had_running
            lines[first:] = [] if proven else [(t, NAMED if k == ARTICLE else k) for t, k in lines[first:]]

    for m in _TOKEN.finditer(page):
        if m.start() > done and not outside:
            hold(page[done: m.start()])
        done = m.end()
        if m.group(1) and m.group(1).lower() == "textarea":
            controls += 1
        name = (m.group(3) or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        controls += name in _CONTROLS and not m.group(2)
        if name in _VOID:
            continue
        if m.group(2):
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), -1)
            # an inline end tag does not close the blocks around it
            if depth >= 0 and (name in _BLOCK or name in _OUTSIDE or not any(s[0] in _BLOCK for s in stack[depth + 1:])):
                if name not in _BLOCK:
                    flush_needed = any(s[1] and s[0] not in _WITHIN for s in stack[depth:])
                    if flush_needed:
                        flush()
                while len(stack) > depth:
                    pop()
            continue
        if m.group(4).endswith("/") and name not in _BLOCK:
            continue
        named, whole, by_id, hidden, main = _marks(m.group(4), name) if m.group(4) and name not in ("html", "body") else (False,) * 5
        named_parts += named and (name in _PARTS or name == "li")
        articles += name == "article"
        running += name in _RUNNING
        suspect = named and inside > 0 and not outside
        out = hidden or not inside and (named or by_id) or suspect and whole and name in _PARTS
        main = name == "main" or not (out or suspect) and (main or name == "article")  # a comment may be an article element too
        out = not main and (out or name in _OUTSIDE or not inside and (name == "header" or bool(_HEADER.search(m.group(4) or ""))))
        if main and outside and not seen:  # the first article, inside a part that was never closed
            while outside:
                pop()
        seen |= main and not outside
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # these close the one before
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == name:
                    while len(stack) > d:
                        pop()
                    break
                if stack[d][0] in _BLOCK and stack[d][0] != "p":
                    break
        if (out and not outside or suspect) and name not in _WITHIN:
            flush()
        main = main and not outside
        suspect = suspect and not out and not main and name not in _WITHIN
        stack.append((name, out, main, (len(lines), letters, linked, controls, named_parts, articles, running) if suspect else None))
        outside += out
        inside += main
        links += name == "a"
    if done < len(page) and not outside:
        hold(page[done:])
    flush()
    while stack:
        pop()
    return lines


#: From so many pairs of lines on, a page pair is aligned by its matches, unless lines repeat too often.
PAIRED = 4_000_000


def _by_matches(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray | None:
    """Positions of ``a`` in one longest common subsequence, in time of the number of equal pairs; None from ``most`` pairs on."""
    where: dict[int, list[int]] = {}
    for j, item in enumerate(b.tolist()):
        where.setdefault(item, []).append(j)
    if sum(len(where.get(item, ())) for item in a.tolist()) > most:
        return None
    last: list[int] = []  # smallest end in b of a common subsequence of each length
    link: list[tuple] = []  # that subsequence, as (position in a, the one before)
    for i, item in enumerate(a.tolist()):
        for j in reversed(where.get(item, ())):
            at = bisect_left(last, j)
            node = (i, link[at - 1] if at else None)
            if at == len(last):
                last.append(j)
                link.append(node)
            elif j < last[at]:
                last[at], link[at] = j, node
    out, node = [], link[-1] if link else None
    while node:
        out.append(node[0])
        node = node[1]
    return np.array(out[::-1], np.int64)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of ``a`` in one longest common subsequence with ``b``; memory grows with the lengths, not their product."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    ends = [np.arange(head), np.arange(n - tail, n)]
    a, b = a[head: n - tail], b[head: m - tail]
    rows = np.flatnonzero(np.isin(a, b))
    a, b = a[rows], b[np.isin(b, a)]
    if len(a) * len(b) > PAIRED:
        few = _by_matches(a, b, 50 * (len(a) + len(b)))
        if few is not None:
            return np.unique(np.concatenate([ends[0], rows[few] + head, ends[1]]).astype(np.int64))

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length with every prefix of y, of all of x."""
        best = np.zeros(len(y) + 1, np.int64)
        for item in x:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (y == item)))
        return best

    found: list[np.ndarray] = []
    work = [(0, len(a), 0, len(b))]
    while work:  # divide the left side in halves and the right side where the two lengths add up to most
        i, j, p, q = work.pop()
        if i == j or p == q:
            continue
        if j - i == 1:
            if (b[p:q] == a[i]).any():
                found.append(np.array([i]))
            continue
        half = (i + j) // 2
        k = int((lengths(a[i:half], b[p:q]) + lengths(a[half:j][::-1], b[p:q][::-1])[::-1]).argmax())
        work += [(i, half, p, p + k), (half, j, p + k, q)]
    middle = rows[np.concatenate(found).astype(np.int64)] + head if found else np.zeros(0, np.int64)
    return np.unique(np.concatenate([ends[0], middle, ends[1]]).astype(np.int64))


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lines = [page_lines(p) if p else [] for p in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[: len(names)], pa.array([[t for t, _ in x] for x in lines], pa.list_(pa.string())),
                    pa.array([[k for _, k in x] for x in lines], pa.list_(pa.int32())), pa.array([[_hash(t) for t, _ in x] for x in lines], pa.list_(pa.int64())),
                ], [*names, "lines", "own", "marks"])

    return run


def kept_lines(lines: list, own: list[int], marks: np.ndarray, neighbours: list[np.ndarray], template: frozenset[int] = frozenset()) -> list:
    """Lines that no neighbour shares, and lines of the article but those of ``template`` that both neighbours share.

    Lines in a part of the article that is named as outside go where one neighbour shares them.

    A neighbour whose lines are all in this page or that has all of this page's lines is a copy of it and
    says nothing about the template. Where no neighbour says anything, the article stays, or all lines where there is none.
    """
    times, compared = np.zeros(len(lines), np.int64), False
    for other in neighbours:
        at = common(marks, other)
        if len(at) < min(len(marks), len(other)):
            times[at] += 1
            compared = True
    where = np.array(own, np.int64)
    article = where > ELSEWHERE
    gone = np.where(where == ARTICLE, (times > 1) & np.isin(marks, list(template)), times > 0)
    if article.any() and not compared:
        gone |= ~article
    return [t for t, g in zip(lines, gone, strict=True) if not g]


def contained(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the shorter of two pages is a subsequence of the other."""
    few, rest = (a, b) if len(a) <= len(b) else (b, a)
    rest = iter(rest.tolist())
    return all(x in rest for x in few.tolist())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, side, step, marks, other) to (place, side, step, copy, other)."""
    for batch in batches:
        copy = [contained(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(copy, pa.bool_()), batch.column(4)], ["place", "side", "step", "copy", "other"])


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of the lines that stay, for pages where these are not just the article or, without one, all lines."""
    for batch in batches:
        hosts, contents, kept = [], [], []
        for host, content, marks, own, before, behind, template in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            usual = [i for i, k in enumerate(own) if k] if any(own) else list(range(len(own)))
            stay = kept_lines(list(range(len(own))), own, np.array(marks, np.int64), [np.array(x or [], np.int64) for x in (before, behind)], frozenset(template or ()))
            if stay != usual:
                hosts.append(host)
                contents.append(content)
                kept.append(stay)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(kept, pa.list_(pa.int32()))], ["host", "content", "kept"])


def _placed(different: DataFrame) -> DataFrame:
    """``different`` with ``place``, its number in the order of host, path and content."""
    spark = different.sparkSession
    order = ["host", "path", "content"]
    ranged = cut(different.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one number for each task
    offsets, at = [], 0
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    base = spark.createDataFrame(offsets, "p long, base long")
    return ranged.join(F.broadcast(base), part == F.col("p")).select(
        "host", "content", "marks", "own", (F.col("base") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("place"))


def _sides(placed: DataFrame) -> DataFrame:
    """(place, before, behind): line hashes of the nearest page on each side that is no copy, contained or containing.

    Pages that met only copies ask on for as many places again as before, until each has met another or the end of its host.
    """
    lent = placed.select(F.col("place").alias("of"), F.col("host").alias("of_host"), F.col("marks").alias("other"))
    ask = placed.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    found, first, n = [], 1, 1
    while True:
        steps = ask.select("place", "side", "host", "marks", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("step"))
        pairs = steps.join(lent, (F.col("place") + F.col("side") * F.col("step") == F.col("of")) & (F.col("host") == F.col("of_host")))
        met = cut(pairs.select("place", "side", "step", "marks", "other").mapInArrow(_met, "place long, side int, step int, copy boolean, other array<long>"))
        found.append(met.filter("not copy").groupBy("place", "side").agg(F.min_by("other", "step").alias("other")))
        left = cut(met.groupBy("place", "side").agg(F.count("*").alias("n"), F.every("copy").alias("copies")).filter((F.col("n") == n) & F.col("copies")).select("place", "side"))
        if not left.head(1):
            break
        ask, first, n = placed.join(left, "place"), first + n, first + n
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every.groupBy("place").agg(F.max(F.when(F.col("side") < 0, F.col("other"))).alias("before"), F.max(F.when(F.col("side") > 0, F.col("other"))).alias("behind"))


def _template(placed: DataFrame) -> DataFrame:
    """(host, template): line hashes on more than half of the different pages of a host; at most twice as many as a page has on average."""
    counts = placed.select("host", F.explode(F.array_distinct("marks")).alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).filter("n > 2")
    hosts = cut(placed.groupBy("host").agg(F.count("*").alias("pages")).filter("pages > 2"))
    return cut(counts.join(hosts, "host").filter("2 * n > pages").groupBy("host").agg(F.collect_list("mark").alias("template")))


def extract_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text) of every row of ``pages``: the whole article, blocks joined by one space.

    A null or empty page has an empty text; pages without a URL or host form one host; null and repeated
    keys pass through, one row each; a page that is the only different one of its host keeps its article, or all
    lines that markup leaves. The different pages of a host are ordered by path over all tasks at once, so a
    large host fills no task; each page, with an article element or without, meets its two neighbours by its
    place in that order. Pages are parsed once, and only hashes of lines move to neighbours.
    """
    # the scheme and "www." do not tell hosts apart; fragment and query end the path
    address = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    host, path = F.regexp_extract(address, r"^([^/?#]*)", 1), F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1)
    named = pages.select(F.col(key).alias("key"), "url", host.alias("host"), path.alias("path"), "html")
    schema = StructType([*named.schema.fields[:4], StructField("lines", ArrayType(StringType())), StructField("own", ArrayType(IntegerType())), StructField("marks", ArrayType(LongType()))])
    parsed = cut(named.mapInArrow(_parsed(["key", "url", "host", "path"]), schema).withColumn("content", F.xxhash64("marks", "own")))
    placed = cut(_placed(parsed.groupBy("host", "content").agg(F.min("path").alias("path"), F.min("marks").alias("marks"), F.min("own").alias("own"))))
    compared = placed.join(_sides(placed), "place", "left").join(_template(placed), "host", "left").select("host", "content", "marks", "own", "before", "behind", "template")
    # written, so that its size is known: where markup and neighbours agree on nearly all pages, no text moves
    changed = cut(compared.mapInArrow(_differenced, "host string, content long, kept array<int>")).select(F.col("host").alias("_host"), F.col("content").alias("_content"), "kept")
    usual = F.when(F.exists("own", lambda k: k > ELSEWHERE), F.filter("lines", lambda t, i: F.element_at("own", i + 1) > ELSEWHERE)).otherwise(F.col("lines"))
    kept = F.when(F.col("kept").isNull(), usual).otherwise(F.transform("kept", lambda i: F.element_at("lines", i + 1)))
    joined = parsed.join(changed, (F.col("host") == F.col("_host")) & (F.col("content") == F.col("_content")), "left")
    return joined.select(F.col("key").alias(key), "url", F.array_join(kept, " ").alias("text"))
