import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlcorpus.llm import blocks, minhash
from sqlcorpus.llm.components import connected_components
from sqlcorpus.llm.minhash import Sampler, near_duplicates
from sqlcorpus.llm.queries import op1_minhash_near_dedup

SF = "/root/testdata/sf0.001"


def plain_classes(docs, threshold=0.8):
    found = {}
    for key, text in docs:
        words = (text or "").lower().split()
        k = min(5, len(words))
        found[key] = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else Counter()
    df, n = Counter(x for c in found.values() for x in c), len(docs)
    idf = {x: 1 + minhash.IDF_RANGE * math.log((1 + n) / (1 + v)) / math.log(1 + n) for x, v in df.items()}
    total = {i: sum(idf[x] * v for x, v in c.items()) for i, c in found.items()}
    root = {i: i for i in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(found), 2):
        common = found[a].keys() & found[b].keys()
        if common:
            shared = sum(idf[x] * min(found[a][x], found[b][x]) for x in common)
            if shared >= threshold * (total[a] + total[b] - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in found}


@pytest.mark.parametrize("piece", [3, 512])
def test_query_equals_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 100_000)
    monkeypatch.setattr(blocks, "PER_MESSAGE", 1)
    monkeypatch.setattr(minhash, "PIECE", piece)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op1_minhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got) and len(got) == len(docs)


def test_near_copies_in_one_large_group(spark, workspace, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 8)
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(200)]
    docs = [(100, " ".join(words))]
    for i in range(60):
        own = list(words)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(200)] = f"v{rng.random()}"
        docs.append((rng.choice([1000, 0]) + i + 1, " ".join(own)))
    docs += [(5000 + i, " ".join(f"u{rng.random()}" for _ in range(60))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(frame, workspace).collect()} == plain_classes(docs)


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    sampler, hashes = Sampler(), rng.integers(1, 2 ** 63, 40).astype(np.uint64)
    a, b = rng.uniform(0.2, 3, 40), rng.uniform(0.2, 3, 40)
    a[:5], b[35:] = 1e-6, 1e-6
    k = 3000
    s = sampler.signature(np.concatenate([hashes, hashes]), np.concatenate([a, b]), np.repeat([0, 1], 40), 2, k)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 4 * 0.5 / k ** 0.5


def test_odd_rows(spark, workspace):
    same = "a text of more than five words that comes more than once here"
    rows = [(1, None), (2, ""), (3, " \n"), (9, same), (4, same), (4, same), (None, same), (6, "two words"), (7, "Two  words"),
            (8, "other " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_class", F.lit("x")).withColumn("kept", F.lit(0))
    got = sorted(((r.doc_id or 0), r.class_id or 0, r.kept) for r in near_duplicates(frame, workspace).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (6, 6, True), (7, 6, False),
                   (8, 8, True), (9, 4, False)]
    assert near_duplicates(frame.limit(0), workspace).count() == 0


def test_components(spark, workspace):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), workspace).collect()
    assert {r.node: r.component for r in got} == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
