"""Personal data: fixed forms, and identifiers of other forms that contexts of the fixed ones lead to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import SLICE, per_batch

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Rounds of scoring; instances a pattern must have, and the confidence it and what it finds must reach.
ROUNDS, SUPPORT, CONFIDENCE = 4, 3, 0.7
#: Characters of an identifier, and of a context word, at most; characters beside an identifier that hold its context.
LONGEST, LONGEST_WORD, BESIDE = 64, 40, 130
#: Bits of the filter through which words are counted; contexts that a task counts before it hands them on.
FILTER_BITS, COUNTED = 1 << 20, 100_000

# Each pattern is tried where the plain one could begin, so that no long run is walked twice. What comes before the
# sign of an address is the run of its characters that ends there; a run of digits either begins a match or lies in one.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile("[0-9@]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
TOKEN = re.compile(r"[^\x20\x09-\x0D:=]++[:=]*+|[:=]++")
#: A word that a number of several words begins with, perhaps behind a label; one that goes on; one that ends it.
LEADS, FOLLOWS, STOPS = (re.compile(p) for p in (r"(?:[^:=]*[:=])?[0-9()+./-]+", r"[0-9()+./-]+", r"[0-9()+./-]+[,;!?]+"))
#: Other forms that an identifier of a kind may have.
FORMS = (
    (EMAIL, re.compile(r"[^@\s]+@[^@\s]+")),
    (IP, re.compile(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}|(?=.*:.*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")),
    (CARD, re.compile(r"[0-9](?:[ ./-]?[0-9]){11,18}")),
    (PHONE, re.compile(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}")),
)
OUTER = ".,;!?\"'()[]{}<>"
AS_ZERO = str.maketrans("123456789", "000000000")


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, leftmost and without overlaps inside a kind, in order."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at)
        low = len(text[done:at].rstrip(LOCAL)) + done
        if found and low < at:
            out.append((low, EMAIL, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in QUAD.finditer(text):
        # Four digits of a part are over 255 already.
        if all(int(part.lstrip("0")[:4] or 0) <= 255 for part in m.group().split(".")):
            out.append((m.start(), IP, m.end()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    at = text.find("+")
    while at >= 0:
        m = PLUS.match(text, at)
        if m:
            digits = sum(c.isdecimal() for c in m.group())
            if 9 <= digits <= 15:
                out.append((m.start(), PHONE, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of words that have a looser form of some kind and touch no taken span.

    Words of digits with one blank between them are tried as one first, the longest run of them before shorter ones.
    """
    out: list[tuple[int, int, int]] = []
    words: list[tuple[int, int]] = []
    covered = sorted((s, e) for s, _, e in taken)
    low, next_taken = 0, 0
    found = SIGN.search(text)
    while found:
        at = found.start()
        start = max([low, *(text.rfind(c, low, at) + 1 for c in " \t\n\v\f\r")])
        gap = SPACE.search(text, at)
        end = gap.start() if gap else len(text)
        while next_taken < len(covered) and covered[next_taken][1] <= start:
            next_taken += 1
        if not (next_taken < len(covered) and covered[next_taken][0] < end):
            words.append((start, end))
        low = end
        found = SIGN.search(text, end)
    i = 0
    while i < len(words):
        start, end = words[i]
        run = i + 1
        if end - start <= LONGEST and LEADS.fullmatch(text, start, end):
            while (run < len(words) and words[run][0] == words[run - 1][1] + 1 and text[words[run][0] - 1] == " "
                   and words[run][1] - start <= LONGEST and (FOLLOWS.fullmatch(text, *words[run]) or STOPS.fullmatch(text, *words[run]))):
                run += 1
                if not FOLLOWS.fullmatch(text, *words[run - 1]):
                    break
        for last in range(run, i, -1):
            span = _core(text, start, words[last - 1][1])
            if span and (kinds := _forms(text[span[0]:span[1]])):
                out.append((*span, kinds))
                i = last
                break
        else:
            i += 1
    return out


def _core(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span without a label in front of it and punctuation around it, unless it is too long."""
    if end - start > 2 * LONGEST:
        return None
    word = text[start:end]
    sign = SIGN.search(word).start()
    if word.count(":") < 2 or not FORMS[IP][1].fullmatch(word.strip(OUTER)):
        label = max(word.rfind(":", 0, sign), word.rfind("=", 0, sign)) + 1
        start, word = start + label, word[label:]
    front = len(word) - len(word.lstrip(OUTER))
    if word[front - 1:front] == "(" and ")" in word[front:]:
        front -= 1
    core = word[front:].rstrip(OUTER + ":=")
    return (start + front, start + front + len(core)) if 0 < len(core) <= LONGEST else None


def _forms(core: str) -> int:
    return sum(1 << kind for kind, form in FORMS if form.fullmatch(core))


def lexical(token: str) -> str:
    """A word as contexts know it: small letters, without punctuation around it, every digit a zero; "" if it is long."""
    word = token.lower().strip(OUTER).translate(AS_ZERO)
    return word if len(word) <= LONGEST_WORD else ""


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, the two words before, the word behind."""
    low = max(0, start - BESIDE)
    before = TOKEN.findall(text, low, start)
    before = [w for w in map(lexical, before[1:] if low else before) if w][-2:]
    out = []
    if before:
        out.append(f"1 {before[-1]}")
    if len(before) == 2:
        out.append(f"2 {before[0]} {before[1]}")
    for token in TOKEN.finditer(text, end, end + BESIDE):
        word = lexical(token.group())
        if word and (token.end() < end + BESIDE or end + BESIDE >= len(text)):
            out.append(f"3 {word}")
        if word:
            break
    return out


def count_contexts(texts: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """(pattern, occurrences): how often the words of each pattern occur in all texts, whatever is beside them.

    Tasks only count words that pass a filter of ``FILTER_BITS`` bits, the one thing that the driver hears of the
    patterns; what passes by chance finds no partner in the join.
    """
    words = patterns.select(F.expr("substring(pattern, 3)").alias("words")).distinct()
    bucket = (F.crc32(F.col("words").cast("binary")) % FILTER_BITS).cast("int")
    held = bytearray(FILTER_BITS)
    for row in words.select(bucket.alias("b")).distinct().collect():
        held[row["b"]] = 1
    passed = bytes(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        known: dict[str, str] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                seen: Counter[str] = Counter()
                for text in batch.column(0).slice(begin, SLICE).to_pylist():
                    tokens = TOKEN.findall(text or "")
                    for token in tokens:
                        if token not in known:
                            known[token] = lexical(token)
                    row = [w for w in map(known.__getitem__, tokens) if w]
                    seen.update(row)
                    seen.update(map(" ".join, zip(row, row[1:])))
                for words, n in seen.items():
                    if passed[zlib.crc32(words.encode()) % FILTER_BITS]:
                        counts[words] += n
                if len(known) > COUNTED:
                    known.clear()
                if len(counts) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"words": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"words": list(counts), "n": list(counts.values())})

    counted = texts.select(F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, "words string, n long")
    counted = counted.groupBy("words").agg(F.sum("n").alias("occurrences"))
    return patterns.withColumn("words", F.expr("substring(pattern, 3)")).join(counted, "words").select(
        "pattern", "occurrences")


def find_identifiers(docs: DataFrame, workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id, base, added), spans of personal data as (start, kind, end) in code points.

    ``base`` are the fixed forms: addresses, dotted quads up to 255, 12 to 19 digits that pass Luhn's check, and 9 to
    15 digits behind a plus sign. They are the seeds. The words beside an identifier are its patterns; words that look
    like an identifier of some kind without having its fixed form (a phone number without country code, digits that
    fail the check, an address without a dot) are candidates.

    Patterns and instances, which are distinct identifiers or candidates, form a graph with an edge for each time a
    pattern stands beside an instance. In each round a pattern's confidence in a kind is the score of the instances
    beside it, over how often its words occur in the corpus plus one, and an instance's score is one minus the
    product of what its patterns leave open; seeds have one. Only patterns with ``SUPPORT`` instances and
    ``CONFIDENCE`` count. What is found makes new patterns, for ``ROUNDS`` rounds. Candidates that reach ``CONFIDENCE`` are added wherever they occur, as the kind in which they score best;
    they touch no base span and no other added one.

    Texts are read twice, once for identifiers and once for the words of patterns; what is shuffled are the rare
    identifiers, counted by pattern and instance before, so an identifier or a word that stands in a third of all
    rows is one edge a task. Nulls and empty texts have no spans; a null id stays a row, rows that repeat or share
    an id are rows of their own, and copies count as often as they occur. Words of any length are read whole, but an
    identifier has at most ``LONGEST`` characters and a context word ``LONGEST_WORD``. An empty table gives an empty
    result. Extra columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = "struct<start:long,kind:int,end:long>"
    loose = "struct<start:long,kind:int,end:long,kinds:int,surface:string,contexts:array<string>>"
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                       F.col(f"`{text_col}`").cast("string").alias("_text"))

    def make():
        def mention(text: str, start: int, end: int, own: int, kinds: int) -> dict:
            return {"start": start, "kind": own, "end": end, "kinds": kinds, "surface": text[start:end].lower(),
                    "contexts": contexts(text, start, end)}

        def work(batch: pa.RecordBatch) -> dict:
            base, mentions = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                fixed = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in fixed])
                mentions.append([mention(text, s, e, k, 0) for s, k, e in fixed if e - s <= 4 * LONGEST] + [
                    mention(text, s, e, -1, kinds) for s, e, kinds in loose_spans(text, fixed)])
            return {"_row": batch.column(0), "_id": batch.column(1), "base": base, "mentions": mentions}
        return work

    found = workspace.table(per_batch(
        rows, make, f"_row long, _id {kind}, base array<{span}>, mentions array<{loose}>"), "found")
    mentions = found.select("_row", F.explode("mentions").alias("m")).select(
        "_row", "m.start", "m.end", F.col("m.kind").alias("own"), "m.kinds",
        F.md5(F.col("m.surface").cast("binary")).alias("instance"), "m.contexts")
    beside = mentions.withColumn("pattern", F.explode("contexts"))
    of_kind = beside.withColumn("kind", F.explode(F.filter(
        F.array(*[F.lit(k) for k in range(4)]),
        lambda k: F.when(F.col("own") >= 0, k == F.col("own")).otherwise(
            F.call_function("shiftright", F.col("kinds"), k).bitwiseAND(F.lit(1)) == 1))))
    edges = of_kind.groupBy("pattern", "instance", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("own") >= 0).alias("seed"))
    edges = workspace.table(edges, "edges")
    enough = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("_instances")).where(
        F.col("_instances") >= SUPPORT).select("pattern", "kind")
    patterns = workspace.table(enough.select("pattern").distinct(), "patterns")
    edges = workspace.table(edges.join(enough, ["pattern", "kind"]).join(
        count_contexts(docs, patterns, text_col), "pattern"), "counted")

    scores = edges.where("NOT seed").select("instance", "kind", F.lit(0.0).alias("score")).limit(0)
    for _ in range(ROUNDS):
        scored = edges.join(scores, ["instance", "kind"], "left").withColumn(
            "_s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        good = scored.groupBy("pattern", "kind").agg(
            (F.sum(F.col("n") * F.col("_s")) / (F.max("occurrences") + 1)).alias("_sure"),
            F.count(F.when(F.col("_s") >= CONFIDENCE, 1)).alias("_instances"),
        ).where((F.col("_instances") >= SUPPORT) & (F.round("_sure", 9) >= CONFIDENCE))
        open_part = F.log(1 - F.least(F.col("_sure"), F.lit(0.999)))
        led = edges.where("NOT seed").join(good.select("pattern", "kind", "_sure"), ["pattern", "kind"])
        scores = workspace.table(led.groupBy("instance", "kind").agg(
            F.round(1 - F.exp(F.sum(open_part)), 9).alias("score")), "scores")
        if not scores.take(1):
            break

    best = scores.where(F.col("score") >= CONFIDENCE).groupBy("instance").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "kind"))["kind"].alias("kind"))
    added = mentions.where("own < 0").join(best, "instance").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    return found.join(added, "_row", "left").select(
        F.col("_id").alias(id_col), "base", F.coalesce("added", F.array().cast(f"array<{span}>")).alias("added"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
