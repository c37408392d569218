import cProfile
import hashlib
import pstats
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sqlcorpus.llm import blocks
from sqlcorpus.llm.queries import op3_suffix_array_dedup
from sqlcorpus.llm.sais import permuted_prefixes, suffix_array
from sqlcorpus.llm.blocks import measure_blocks
from sqlcorpus.llm.suffix import Block, answer, judge, read_bits, remove_repeats

SF = "/root/testdata/sf0.001"


def plain_removal(docs, width=50):
    """{id: (mask, text)} by looking every window up among those of smaller ids."""
    seen, out = {}, {}
    for key, text in sorted(docs):
        gone = np.zeros(len(text), dtype=bool)
        windows = [text[p:p + width] for p in range(len(text) - width + 1)]
        for p, w in enumerate(windows):
            if w in seen and seen[w] < key:
                gone[p:p + width] = True
        for w in windows:
            seen.setdefault(w, key)
        out[key] = gone, text
    return out


def kept(mask, text):
    return bytes(np.frombuffer(text, dtype=np.uint8)[~mask])


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    text = [rng.randint(1, rng.choice([1, 2, 4, 300])) for _ in range(rng.randint(0, 90))]
    text = (text * rng.choice([1, 1, 4]))[:200] + [0]
    sa = suffix_array(np.array(text), 301)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    found = permuted_prefixes(np.array(text), sa, 1)
    for a, b in zip(sa, sa[1:]):
        n = 0
        while text[a + n] == text[b + n] > 1:
            n += 1
        assert found[b] == n


def test_suffix_array_takes_few_steps():
    """Characters compared double from step to step, so the number of steps does not grow with the text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(10_000)).encode() * 2
    t = np.append(np.frombuffer(text, dtype=np.uint8).astype(np.int32) + 2, 0)
    profile = cProfile.Profile()
    sa = profile.runcall(suffix_array, t, 258)
    assert pstats.Stats(profile).total_calls < 1000
    at = rng.sample(range(len(sa) - 1), 2000)
    assert sorted(sa.tolist()) == list(range(len(t))) and all(text[sa[i]:] < text[sa[i + 1]:] for i in at)


def test_a_shard_answers_with_the_smallest_owners():
    rng = random.Random(4)
    runs = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(40)]
    held = {(rng.choice(runs)[:25] + rng.choice(runs)).encode()[:rng.randint(21, 55)] for _ in range(200)}
    sent = [(b, sorted(rng.sample(sorted(held), 60))) for b in range(5)]
    owners = [np.array([rng.randint(0, 99) for _ in texts]) for _, texts in sent]
    low = {}
    for (_, texts), own in zip(sent, owners):
        for t, o in zip(texts, own.tolist()):
            for p in range(len(t) - 20):
                low[t[p:p + 21]] = min(low.get(t[p:p + 21], 1000), o)
    got = judge(pa.table({
        "_shard": [0] * 5, "_block": [b for b, _ in sent], "_texts": [b"".join(t) for _, t in sent],
        "_lengths": [np.array([len(x) for x in t], dtype=np.uint16).tobytes() for _, t in sent],
        "_owners": [o.astype(np.int64).tobytes() for o in owners],
        "_marks": [np.zeros(len(t), dtype=np.uint16).tobytes() for _, t in sent]}), 21)
    for (_, texts), firsts in zip(sent, got.column("_firsts").to_pylist()):
        assert np.frombuffer(firsts, dtype=np.int64).tolist() == [low[t[p:p + 21]] for t in texts for p in range(len(t) - 20)]


def test_query_equals_plain_removal(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 60_000)
    monkeypatch.setattr(blocks, "PER_MESSAGE", 1)
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_removal(docs)
    got = op3_suffix_array_dedup(spark, SF).collect()
    assert len(got) == len(docs) and sum(r.n_removed for r in got) > 1000
    for r in got:
        mask, text = want[r.doc_id]
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), int(mask.sum()), runs)
        assert r.kept_sha256 == hashlib.sha256(kept(mask, text)).hexdigest()


@pytest.mark.parametrize("block", [200, 3000, 1 << 21])
def test_hard_texts(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", block)
    monkeypatch.setattr(blocks, "PER_MESSAGE", 1)
    rng = random.Random(2)
    passage = "".join(rng.choice("abc ") for _ in range(90))
    texts = ["", "a" * 49, "a" * 50, "a" * 400, "ab" * 100, "é" * 40, passage, "x" + passage + "y", passage * 3, "\0" * 60,
             passage[:50], "ü" + passage[20:75] + "漢字" * 30, "漢字" * 30, "a" * 120 + passage]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) + passage[rng.randint(0, 60):] for _ in range(25)]
    docs = [(i, t) for i, t in enumerate(texts)]
    want = plain_removal([(i, t.encode()) for i, t in docs])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for r in remove_repeats(frame).collect():
        mask, text = want[r.doc_id]
        assert bytes(r.kept) == kept(mask, text), r.doc_id
        assert r.n_removed == sum(s.end - s.start for s in r.spans) == mask.sum()
    for r in remove_repeats(frame, characters=True).collect():
        bytes(r.kept).decode("utf-8")
        assert len(r.kept) >= len(want[r.doc_id][1]) - want[r.doc_id][0].sum()


def test_odd_rows(spark):
    same = "one passage that is long enough to be found wherever it stands in a text " * 2
    rows = [(1, None), (2, ""), (5, same), (5, same), (None, same), (3, "é" + same)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_block", F.lit(1)).withColumn("kept", F.lit(2))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.rest._block) for r in remove_repeats(frame, carry=("_block",)).collect())
    n = len(same)
    assert got == [(0, n, n, 1), (1, 0, 0, 1), (2, 0, 0, 1), (3, n + 2, 0, 1), (5, n, n, 1), (5, n, n, 1)]
    assert remove_repeats(frame.limit(0)).count() == 0


def contexts(n):
    """Documents that hold one passage in different contexts, some of them in two documents."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(160))
    around = ["".join(rng.choice("klmnopqrst ") for _ in range(60)) for _ in range(n)]
    return [(i, a + passage + a[::-1]) for i, a in enumerate([*around, *around[:n // 100]])]


def by_shard(tables):
    every = pa.concat_tables(tables)
    return [every.filter(pc.equal(every.column("_shard"), s)) for s in every.column("_shard").unique().to_pylist()]


def test_contexts_of_a_hot_passage_stay_in_their_blocks():
    docs, n, width, n_shards = contexts(3000), 4, 50, 16
    parts = [pa.table({"_id": [i for i, _ in docs[b::n]], "_text": [t.encode() for _, t in docs[b::n]],
                       "_block": [b] * len(docs[b::n])}) for b in range(n)]
    held = [Block(p, n_shards, width) for p in parts]

    def exchange(questions, most):
        answers = pa.concat_tables([answer(t, most) for t in by_shard(questions)])
        return [answers.filter(pc.equal(answers.column("_block"), b)) for b in range(n)]
    first = exchange([h.questions(b) for b, h in enumerate(held)], 50)
    second = exchange([h.window_questions(first[b], b) for b, h in enumerate(held)], float("inf"))
    assert any(any(t.column("_hot").to_pylist()) for t in first) and not any(any(t.column("_hot").to_pylist()) for t in second)
    holders, size = Counter(w for _, t in docs for w in {t.encode()[p:p + width] for p in range(len(t) - width + 1)}), Counter()
    of_window = {}
    for b, h in enumerate(held):
        places, last, run, shard, mark = h.stretches(first[b], second[b])
        texts, which = h.passages(places, last)
        for t, s in zip(texts, shard[np.unique(which, return_index=True)[1]]):
            size[s] += len(t)
        # Equal windows meet in one portion of one shard, and of hot digests only shared windows are sent.
        for p, e, r, s, m in zip(places, last, run, shard, mark):
            for k in range(p, e + 1):
                assert of_window.setdefault(h.raw[k:k + width], (s, m)) == (s, m)
        hot = read_bits(h.keys, first[b])[1][h.inverse][run]
        alone = [k for p, e, is_hot in zip(places, last, hot) if is_hot for k in range(p, e + 1)]
        assert len(alone) > 1000 and all(holders[h.raw[p:p + width]] > 1 for p in alone)
    assert max(size.values()) < 2 * sum(size.values()) / n_shards
    assert all(w in of_window for w, n_docs in holders.items() if n_docs > 1)


def test_hot_passage_equals_plain_removal(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 60_000)
    monkeypatch.setattr(blocks, "PER_MESSAGE", 1)
    docs = contexts(1500)
    want = plain_removal([(i, t.encode()) for i, t in docs])
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert measure_blocks(spark.createDataFrame(docs, "doc_id long, text string"), "text")[1] / 100 < 1500  # so it is hot
    assert len(got) == len(docs) and all(bytes(r.kept) == kept(*want[r.doc_id]) for r in got)


def test_null_and_repeated_ids_are_spread(spark, monkeypatch):
    """Rows without an id, and rows that share one, are dealt over all blocks by their texts."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 5000)
    monkeypatch.setattr(blocks, "PER_MESSAGE", 1)
    rng = random.Random(8)
    docs = [(None if i % 3 else 7, "".join(rng.choice("abcdefgh ") for _ in range(200))) for i in range(600)] + [(1, None)] * 50
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    n = blocks.count_blocks(frame, "text")
    sizes = [r["count"] for r in blocks.in_blocks(frame.where("text is not null"), n, "doc_id", "text").groupBy("_block").count().collect()]
    assert n > 15 and len(sizes) == n and max(sizes) < 3 * 600 / n
    assert remove_repeats(frame).count() == len(docs)
