"""Personal data against the plain patterns, and identifiers that contexts lead to."""

import random
import re

from pyspark.sql import functions as F

from sqlcorpus.llm.pii import KINDS, base_spans, contexts, find_identifiers, loose_spans, luhn, spans_text

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        if kind == 2:
            total = 0
            for i, d in enumerate(reversed(digits)):
                d = int(d) * (1 + i % 2)
                total += d - 9 if d > 9 else d
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if good(k, m.group()))


def valid_card(rng, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@@", ".", "..", "-", "+", "+1", "é", " ", "\n", "(", ")", "%", "1", "22", "255", "256", "0000255",
             "3.4.5.6", "4111 1111 1111 1111", "x@y.z", "x@y", "@y.zz", "+1 (555) 123-4567", "99999999999999999999", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain_spans(text), text
    for text in ("x" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "@a" * 100_000, "+1" + " (" * 100_000, "1 " * 100_000,
                 "a@" * 100_000, "1.2.3" * 50_000, "a." * 100_000 + "@b.c", "x@" + "y." * 100_000, "12@" * 100_000):
        base = base_spans(text)
        assert loose_spans(text, base) is not None
    assert base_spans("0" * 5000 + "1.2.3.4") == [(0, 1, 5007)]


def test_loose_spans_and_contexts():
    text = "Ring (456) 555-2186, or tel:555 0199 now; ip=300.1.2.3 bob@host v2 4111 1111 1111 1112."
    found = {text[s:e]: kinds for s, e, kinds in loose_spans(text, base_spans(text))}
    assert found == {"(456) 555-2186": 8, "555 0199": 8, "300.1.2.3": 2, "bob@host": 1, "4111 1111 1111 1112": 4}
    start = text.index("555 0199")
    assert contexts(text, start, start + 8) == ["1 tel:", "2 or tel:", "3 now"]
    assert contexts("a" * 50 + " 5", 51, 52) == [] and contexts("", 0, 0) == []
    assert loose_spans("id " + "7" * 100_000, []) == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("_row", F.lit("x")).withColumn(
        "a.b", F.lit(2))


def test_contexts_lead_to_identifiers(spark, workspace):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    phone = lambda: f"+1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"{prose(20)} my phone: {phone()} {prose(20)}") for i in range(12)]
    rows += [(20, f"{prose(9)} my phone: 555-0199 {prose(9)}"), (21, f"{prose(9)} elsewhere 555-0199 {prose(9)}"),
             (22, f"{prose(9)} room 555-0123 {prose(9)}")]
    # An ordinary word stands before many things, so it is no pattern although numbers follow it, too.
    rows += [(30 + i, f"{prose(5)} the {phone()} and the {prose(3)} the {prose(4)} the {prose(2)}") for i in range(9)]
    rows += [(50, f"{prose(5)} the 777-4321 {prose(5)}"), (60, None), (61, ""), (None, "call +44 20 7946 0958"), (0, rows[0][1]),
             (62, "z" * 200_000 + " phone: 12 34 56 78"), (63, "my phone: " + " " * 100_000 + "555-7777")]
    got = find_identifiers(frame(spark, rows), workspace).select(
        "doc_id", "base", "added", spans_text(F.concat("base", "added")).alias("spans")).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    added = {(r.doc_id, texts[r.doc_id][s.start:s.end], KINDS[s.kind]) for r in got for s in r.added}
    assert added == {(20, "555-0199", "phone"), (21, "555-0199", "phone"), (62, "12 34 56 78", "phone")}
    for r in got:
        assert [tuple(s) for s in r.base] == plain_spans(texts[r.doc_id])
        every = sorted([*map(tuple, r.base), *map(tuple, r.added)])
        assert r.spans == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in every)
    assert find_identifiers(frame(spark, rows).limit(0), workspace).count() == 0


def test_every_row_counts(spark, workspace):
    """A third of all rows share one identifier and one context."""
    rows = [(i, "card no: 4111111111111111 end") for i in range(300)] + [(i, f"plain text {i}") for i in range(600)]
    rows += [(1000 + i, f"card no: {valid_card(random.Random(i))} end") for i in range(5)] + [(2000, "card no: 4111111111111112 end")]
    got = {r.doc_id: r for r in find_identifiers(frame(spark, rows), workspace).collect() if r.doc_id >= 1000}
    assert [tuple(s) for s in got[2000].added] == [(9, 2, 25)] and got[2000].base == []
    assert all(r.added == [] for i, r in got.items() if i < 2000)
