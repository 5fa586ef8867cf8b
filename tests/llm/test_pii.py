import hashlib
import random
import re

import pytest

from tidemark.llm import pii
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_against_plain_patterns():
    draw = random.Random(3)
    for _ in range(40_000):
        text = "".join(draw.choice("aZ@@..--+ 019255%_()ß") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == brute(text)
    for text in ("4111 1111 1111 1111", "0" * 13, "x" * 100_000, "1" * 100_000, "1." * 50_000, "+" * 50_000, "+1(" * 50_000, "@" * 50_000, "a@" * 50_000):
        assert isinstance(pii.base_spans(text), list)


def test_query(spark, documents):
    rows = QUERIES["op8_pii"](spark, SF).toPandas().set_index("doc_id")
    assert len(rows) == len(documents)
    for key, text in zip(documents.doc_id, documents.text):
        want, row = brute(text or ""), rows.loc[key]
        assert row.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert set(joined(want).split(",")) <= set(row.spans.split(",")) | {""}


@pytest.fixture(scope="module")
def contexts(spark):
    rows = [(i, f"lorem ipsum dolor. Contact phone: +1 (555) 555-{1000 + i} amet the of") for i in range(12)]
    rows += [(100 + i, f"foo bar phone: 555-123-{4000 + i} baz") for i in range(3)]
    rows += [(200, "the code 555-123-4999 of it"), (201, "the code 12345678 of it"), (202, "the phone: is there"), (None, "phone: 555-123-4999"), (None, "phone: 555-123-4999")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_of_seeds_find_unseen_identifiers(contexts):
    found = [(r.doc_id, r.base, r.further) for r in pii.find_pii(contexts).collect()]
    further = {k: [tuple(s) for s in f] for k, _, f in found if k is not None}
    assert all(further[100 + i] == [(3, 15, 27)] for i in range(3))
    assert further[200] == further[201] == further[202] == [] and all(further[i] == [] for i in range(12))
    assert [[tuple(s) for s in f] for k, _, f in found if k is None] == [[(3, 7, 19)]] * 2


def test_common_words_before_seeds_find_nothing(spark):
    rows = [(i, f"the of and the {i % 200}.{i % 7}.1.2 the of the and 555-123-{4000 + i} the") for i in range(40)]
    assert all(not r.further for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_redaction_keeps_columns_and_rows(spark, contexts, odd_documents, no_documents):
    rows = pii.redact(contexts.selectExpr("doc_id", "text", "length(text) as n_chars", "'x' as mark")).collect()
    assert len(rows) == 20 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.doc_id == 101} == {"foo bar phone: [phone] baz"}
    assert sum(r.text == "phone: [phone]" for r in rows) == 2 and not any("+1" in r.text for r in rows)
    same = pii.redact(odd_documents)
    assert same.columns == odd_documents.columns and same.count() == 12 and pii.redact(no_documents).count() == 0


def test_odd_rows(odd_documents, no_documents):
    rows = pii.find_pii(odd_documents).collect()
    assert len(rows) == 12 and all(r.base == [] and r.further == [] for r in rows)
    assert pii.find_pii(no_documents).count() == 0


def test_discovered_identifiers_prove_further_contexts(spark):
    rows = [(i, f"Contact phone: +1 (555) 555-{1000 + i} amet") for i in range(100)]
    for hop, word in enumerate(("phone:", "tel", "ring", "dial", "buzz")):  # each shares 20 numbers with the one before and has 5 new ones
        rows += [(100 * (hop + 1) + i, f"foo {word} 555-123-{4000 + 5 * hop + i} bar") for i in range(25)]
    found = {r.doc_id: r.further for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[k]) == 1 for k, _ in rows if k >= 100)


def test_candidates_span_single_blanks(spark):
    cards = [c for c in (f"4111 1111 1111 {n}" for n in range(1000, 1200)) if luhn(c.replace(" ", ""))][:12]
    rows = [(i, f"my card: {c} ok") for i, c in enumerate(cards)] + [(50 + i, f"his phone: +1 (555) 555-{1000 + i} amet") for i in range(12)]
    spaced = {100: ("phone", "his phone: (555) 123-4567 baz"), 101: ("card", "my card: 4111 1111 1111 1112 ok"), 102: ("phone", "his phone: 555 123 4567, x")}
    frame = spark.createDataFrame(rows + [(k, t) for k, (_, t) in spaced.items()], "doc_id long, text string")
    found = {r.doc_id: [(pii.KINDS[k], frame_text[s:e]) for k, s, e in r.further] for r in pii.find_pii(frame).collect() if (frame_text := spaced.get(r.doc_id, ("", ""))[1])}
    assert found == {100: [("phone", "(555) 123-4567")], 101: [("card", "4111 1111 1111 1112")], 102: [("phone", "555 123 4567")]}


def test_long_identifiers_and_contexts_stay_whole(spark):
    long = "prefix" * 30  # contexts and identifiers that agree in their first 180 characters
    rows = [(i, f"see {long}right: me{i}@{long}.org now") for i in range(8)] + [(50, f"see {long}right: you@{long} now"), (51, f"see {long}wrong: you@{long}x now")]
    rows += [(60 + i, f"{long}wrong: plain word") for i in range(9)]
    found = {r.doc_id: r.further for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[50]) == 1 and found[51] == []
    # identifiers that differ only behind the 64th character are different instances: four do not make a pattern, five do
    same = "a" * 70
    few = lambda n: [(i, f"mail: {same}{i}@x.org") for i in range(n)] + [(90, f"mail: {same}@y")]
    for n in (4, 5):
        found = {r.doc_id: r.further for r in pii.find_pii(spark.createDataFrame(few(n), "doc_id long, text string")).collect()}
        assert len(found[90]) == (n == 5)


def test_contexts_far_back_are_found():
    text = "alpha " + "b" * 500 + " " * 300 + "4"
    assert pii._patterns(text, len(text) - 1) == [pii._named("b" * 500), pii._named("alpha " + "b" * 500)]
    assert pii._patterns("x 4", 2) == ["x"] and pii._patterns("4", 0) == [] and len({pii._named("c" * n) for n in range(60, 90)}) == 30
