"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import keep_rows, per_batch

WINDOW = 8
#: Fixed values.
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


class Measures:
    """Measures of one text, each taken when first asked for. Words are runs of all but ASCII white space."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]

    @property
    def words(self) -> list[bytes]:
        if not hasattr(self, "_words"):
            self._words = self.text.encode("utf-8").split()
        return self._words


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more. Digests find candidates, words decide."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    codes = codes * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    digest = codes[:n].copy()
    for i in range(1, width):
        digest *= np.uint64(0xD6E8FEB86659FD93)
        digest += codes[i:i + n]
    order = np.argsort(digest)
    same = digest[order[1:]] == digest[order[:-1]]
    if not same.any():
        return 0
    at = np.zeros(n, dtype=bool)
    at[order[1:][same]] = at[order[:-1][same]] = True
    starts = np.flatnonzero(at).tolist()
    windows = [tuple(words[i:i + width]) for i in starts]
    seen = Counter(windows)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(starts, windows):
        if seen[w] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


MEASURES: dict[str, Callable[[Measures], int]] = {
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: len(m.text) - sum(map(m.text.count, SPACES)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "n_dup_lines": lambda m: dup_lines(m.text),
    "n_lines": lambda m: sum(1 for x in m.text.split("\n") if x.strip(SPACES)),
    "n_repeat_words": lambda m: repeat_words(m.words),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Rejects a text. ``base`` rules are the minimum that any corpus has to meet."""

    name: str
    rejects: Callable[[Measures], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20, base=True),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"], base=True),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    # A short text may well say one of its few lines twice.
    Rule("repeated_lines", lambda m: m["n_dup_lines"] > 2 and 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
)


def cascade_order(sample: list[str], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Greedy: next comes the rule that rejects most of the texts still there per second that it takes for them.

    Measures taken by an earlier rule cost a later one nothing, so cost and rejections are estimated on what is left.
    """
    left, rest, order = [Measures(t) for t in sample], list(rules), []
    while rest:
        best = None
        for rule in rest:
            trial = [Measures(m.text) for m in left]
            for new, old in zip(trial, left):
                new.known = dict(old.known)
            start = time.perf_counter()
            rejected = [rule.rejects(m) for m in trial]
            rate = sum(rejected) / (time.perf_counter() - start + 1e-6 * (1 + len(trial)))
            if best is None or rate > best[0]:
                best = rate, rule, [m for m, r in zip(trial, rejected) if not r]
        order.append(best[1])
        rest.remove(best[1])
        left = best[2]
    return order


def estimated_order(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, rows: int = 300) -> list[Rule]:
    """The rules in the order that ``cascade_order`` finds on at most ``rows`` texts; verdicts do not depend on it.

    One task estimates it, and the driver hears the places of the rules only, however long the texts are.
    """
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for batch in batches for t in batch.column(0).to_pylist()]
        order = cascade_order(texts, rules)
        yield pa.RecordBatch.from_pydict({"place": pa.array([rules.index(r) for r in order], pa.int32())})

    sample = docs.select(F.col(f"`{text_col}`").cast("string")).sample(0.2, seed=7).limit(rows)
    places = [row["place"] for row in sample.coalesce(1).mapInArrow(estimate, "place int").collect()]
    return [rules[i] for i in places] or list(rules)


def judge_quality(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, counts: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, kept, rejected_by, n_rules), and with ``counts`` the base measures and ``base_failed`` of every text.

    Rules run in the order of ``cascade_order`` until one rejects; ``rejected_by`` is that rule and ``n_rules`` how
    many ran. ``kept`` is the same in any order; the order comes from measured costs, so ``rejected_by`` and ``n_rules``
    may differ from run to run. A null or empty text has no words and is rejected as such; every row gives a row, rows
    that repeat or lack an id too; long texts are taken whole. An empty table gives an empty result; extra columns are
    not read, whatever their names.
    """
    order = estimated_order(docs, rules, text_col)
    base = [r for r in rules if r.base]

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            measures = [Measures(t or "") for t in batch.column(1).to_pylist()]
            out: dict = {id_col: batch.column(0), "kept": [], "rejected_by": [], "n_rules": []}
            for m in measures:
                n = next((i for i, r in enumerate(order) if r.rejects(m)), None)
                out["kept"].append(n is None)
                out["rejected_by"].append(None if n is None else order[n].name)
                out["n_rules"].append(len(order) if n is None else n + 1)
            if counts:
                out |= {c: [m[c] for m in measures] for c in COUNTS}
                out["base_failed"] = [any(r.rejects(m) for r in base) for m in measures]
            return out
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", {c} long" for c in COUNTS) + ", base_failed boolean" if counts else ""
    return per_batch(docs.select(id_col, text_col), make,
                     f"`{id_col}` {kind}, kept boolean, rejected_by string, n_rules int{more}")


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows, unchanged and with all their columns, whose text passes all rules, by the same cascade.

    A null text has no words; rows that repeat are judged alike; an empty table stays empty.
    """
    order = estimated_order(docs, rules, text_col)

    def passes(text: str | None) -> bool:
        measures = Measures(text or "")
        return not any(r.rejects(measures) for r in order)

    return keep_rows(docs, [text_col], lambda: lambda batch: list(map(passes, batch.column(0).to_pylist())))
