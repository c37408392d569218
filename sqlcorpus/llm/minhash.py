"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.blocks import count_blocks, in_blocks, mix, shard_of, split_at
from sqlcorpus.llm.components import connected_components
from sqlcorpus.llm.embed import spanning_roots

#: Words of a shingle, bands of a signature, and samples of a band.
WORDS, BANDS, ROWS = 5, 14, 3
#: How much the rarest shingle outweighs one that every document holds, less 1: similarity stays near the plain one.
IDF_RANGE = 0.25
#: Members of a bucket that are compared with each other in one piece, and columns that are multiplied at once.
PIECE, COLUMNS = 256, 2048
SLACK = 1e-9


class WordHash(dict):
    """64-bit digests of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


def shingles(words: list[str], hashes: WordHash) -> np.ndarray:
    """Digests of all runs of five words, or of all words of a shorter text; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    out = codes[:n].copy()
    for i in range(1, width):
        out = mix(out) + codes[i:i + n]
    return mix(out + np.uint64(width))


class Shingled:
    """The documents of a block in a fixed order with their distinct shingles and counts."""

    def __init__(self, part: pa.Table, n_shards: int) -> None:
        part = part.sort_by([("_id", "ascending"), ("_text", "ascending")])
        self.ids, hashes = part.column("_id"), WordHash()
        self.words = [(t or b"").decode("utf-8", "replace").lower().split() for t in part.column("_text").to_pylist()]
        found = [np.unique(shingles(w, hashes), return_counts=True) for w in self.words]
        self.sizes = np.array([len(h) for h, _ in found], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(found)), self.sizes)
        self.hash = np.concatenate([h for h, _ in found]) if found else np.zeros(0, dtype=np.uint64)
        self.tf = np.concatenate([c for _, c in found]) if found else np.zeros(0, dtype=np.int64)
        order = (shard_of(self.hash, n_shards).astype(np.uint64) << np.uint64(40)) | (
            self.hash & np.uint64(0xFFFFFFFFFF))
        self.keys, self.inverse, self.counts = np.unique(order, return_inverse=True, return_counts=True)
        self.shards = (self.keys >> np.uint64(40)).astype(np.int64)

    def questions(self, block: int) -> pa.Table:
        five = self.keys.view(np.uint8).reshape(-1, 8)[:, :5]
        shard, start, end = split_at(self.shards)
        return pa.table({
            "_shard": pa.array(shard, pa.int32()), "_block": pa.array(np.full(len(shard), block), pa.int32()),
            "_tags": pa.array([five[s:e].tobytes() for s, e in zip(start, end)], pa.binary()),
            "_counts": pa.array([self.counts[s:e].astype(np.uint32).tobytes() for s, e in zip(start, end)], pa.binary())})

    def frequencies(self, answers: pa.Table) -> np.ndarray:
        """Document frequency of every (document, shingle)."""
        by_shard = dict(zip(answers.column("_shard").to_pylist(), answers.column("_df").to_pylist()))
        df = np.zeros(len(self.keys), dtype=np.int64)
        for shard, start, end in zip(*split_at(self.shards)):
            df[start:end] = np.frombuffer(by_shard[int(shard)], dtype=np.uint32)
        return df[self.inverse]


def add_up(part: pa.Table) -> pa.Table:
    """Sums the counts of each tag over all blocks and answers every block in its own order."""
    tags = []
    for five in part.column("_tags").to_pylist():
        wide = np.zeros((len(five) // 5, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(five, dtype=np.uint8).reshape(-1, 5)
        tags.append(wide.reshape(-1).view(np.uint64))
    counts = [np.frombuffer(c, dtype=np.uint32) for c in part.column("_counts").to_pylist()]
    _, inverse = np.unique(np.concatenate(tags), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts))[inverse].astype(np.uint32)
    cuts = np.cumsum([len(x) for x in tags])[:-1]
    return pa.table({"_block": part.column("_block"), "_shard": part.column("_shard"),
                     "_df": pa.array([x.tobytes() for x in np.split(total, cuts)], pa.binary())})


class Sampler:
    """Improved consistent weighted sampling: for r, c ~ Gamma(2, 1) and b ~ U(0, 1) of an element and a function,

    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the element with the least a is the sample,
    together with its t. As ln y <= ln w, most elements are ruled out by bounds of c and r from a table; should no
    element be left under the limit, all are looked at.
    """

    def __init__(self) -> None:
        x = np.concatenate([[0], np.geomspace(1e-7, 1e-2, 2000), np.arange(0.011, 40, 0.001)])
        self.x, self.u = x, -np.expm1(-x) - x * np.exp(-x)
        edge = np.interp(np.arange(257) / 256, self.u, x)
        edge[0], edge[256] = 1e-300, 40
        self.bound = (np.log(edge[:256])[:, None] - edge[1:][None]).astype(np.float32).ravel()

    def gamma(self, u: np.ndarray) -> np.ndarray:
        return np.interp(u, self.u, self.x)

    def rank(self, h: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ln a, t) for digests of (element, function). Bits 48-63 bound c and r; the draws agree with them."""
        more = mix(h ^ np.uint64(0x5851F42D4C957F2D))
        fine = (more & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0 ** 32
        c = self.gamma(((h >> np.uint64(56)).astype(np.float64) + fine) / 256)
        fine = (h & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0 ** 32
        r = np.maximum(self.gamma((((h >> np.uint64(48)) & np.uint64(255)).astype(np.float64) + fine) / 256), 1e-12)
        b = (more >> np.uint64(32)).astype(np.float64) / 2.0 ** 32
        t = np.floor(log_w / r + b)
        return np.log(np.maximum(c, 1e-300)) - r * (t - b) - r, t

    def signature(self, element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
        """Samples of ``k`` functions, (n_docs, k); ``doc`` ascends and every document has an element."""
        out = np.zeros((n_docs, k), dtype=np.uint64)
        log_w = np.log(weight)
        limit = np.log(6 / np.bincount(doc, weights=weight, minlength=n_docs))
        room = (limit[doc] + log_w).astype(np.float32)
        for j in range(k):
            h = mix(element + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
            near = np.flatnonzero(self.bound[(h >> np.uint64(48)).astype(np.int64)] <= room + np.float32(1e-3))
            value, t = self.rank(h[near], log_w[near])
            under = value <= limit[doc[near]]
            lacking = np.ones(n_docs, dtype=bool)
            lacking[doc[near[under]]] = False
            rest = np.flatnonzero(lacking[doc])
            at = np.concatenate([near[under], rest])
            value2, t2 = self.rank(h[rest], log_w[rest])
            value, t = np.concatenate([value[under], value2]), np.concatenate([t[under], t2])
            least = np.full(n_docs, np.inf)
            np.minimum.at(least, doc[at], value)
            won = np.flatnonzero(value == least[doc[at]])
            out[doc[at[won]], j] = mix(element[at[won]] ^ mix(t[won].astype(np.int64).view(np.uint64)))
        return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = []
    for band in range(BANDS):
        key = np.full(len(signature), band + 1, dtype=np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + signature[:, j])
        keys.append(key.view(np.int64))
    return np.stack(keys, axis=1)


def pack_features(elements: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    """48 bits of each element, enough to tell those of one bucket apart, and its weight by number in a short list."""
    values, codes = np.unique(weights, return_inverse=True)
    kind = np.uint8 if len(values) <= 256 else np.uint32
    six = np.ascontiguousarray(elements).view(np.uint8).reshape(-1, 8)[:, :6]
    return six.tobytes(), values.tobytes() + codes.astype(kind).tobytes()


def unpack_features(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(elements) // 6
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(elements, dtype=np.uint8).reshape(-1, 6)
    # With one byte an element the list has at most 256 values of eight bytes; else it has more.
    kind = np.uint8 if len(weights) - n <= 256 * 8 and (len(weights) - n) % 8 == 0 else np.uint32
    size = len(weights) - n * np.dtype(kind).itemsize
    values, codes = np.frombuffer(weights[:size], dtype=np.float64), np.frombuffer(weights[size:], dtype=kind)
    return wide.reshape(-1).view(np.uint64), values[codes]


def describe(left: pa.Table, answers: pa.Table, n_docs: int, n_shards: int, threshold: float, idf_range: float, schema):
    """A row a document; with class, bands and features if it can be similar to any other.

    A similarity of s needs a share of s of the own weight in shingles that other documents hold too, so documents
    with less are alone. Of equal documents in a block the first one carries the features.
    """
    block = Shingled(left, n_shards)
    n = len(block.words)
    df = block.frequencies(answers)
    idf = 1 + idf_range * np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) / np.log(1 + max(n_docs, 1))
    weight = block.tf * idf
    total = np.bincount(block.doc, weights=weight, minlength=n)
    common = np.bincount(block.doc, weights=weight * (df > 1), minlength=n)
    able = (total > 0) & (common >= (threshold - SLACK) * total)
    rows: dict[str, list] = {c: [None] * n for c in ("_class", "_bands", "_elements", "_weights")}
    starts = np.append(0, np.cumsum(block.sizes))
    first: dict[bytes, int] = {}
    for k in np.flatnonzero(able).tolist():
        key = hashlib.blake2b(" ".join(block.words[k]).encode("utf-8", "replace"), digest_size=16).digest()
        rows["_class"][k] = key
        first.setdefault(key, k)
    if first:
        chosen = np.array(sorted(first.values()))
        at = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in chosen])
        bands = band_keys(Sampler().signature(
            block.hash[at], weight[at], np.repeat(np.arange(len(chosen)), block.sizes[chosen]), len(chosen), BANDS * ROWS))
        for k, own in zip(chosen.tolist(), bands.tolist()):
            a, b = starts[k], starts[k + 1]
            tf = block.tf[a:b]
            # A shingle with count f is f elements of its idf, so that shared weight is a plain product.
            level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
            elements = np.repeat(block.hash[a:b], tf) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            rows["_bands"][k] = own
            rows["_elements"][k], rows["_weights"][k] = pack_features(elements, np.repeat(idf[a:b], tf))
    return pa.table({"_id": block.ids, **rows}, schema=schema)


def compare(part: pa.Table, threshold: float) -> pa.Table:
    """A spanning set of the links among the members of a bucket's two pieces, by weighted Jaccard similarity."""
    ids = part.column("_rep").to_numpy()
    elements, weights = zip(*map(
        unpack_features, part.column("_elements").to_pylist(), part.column("_weights").to_pylist()))
    total = np.array([w.sum() for w in weights])
    values, first, inverse, counts = np.unique(
        np.concatenate(elements), return_index=True, return_inverse=True, return_counts=True)
    weight = np.concatenate(weights)[first]
    row = np.repeat(np.arange(len(ids)), [len(e) for e in elements])
    column = np.cumsum(counts > 1) - 1
    used = (counts > 1)[inverse]
    row, column, weight = row[used], column[inverse[used]], weight[counts > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(ids), len(ids)))
    for start in range(0, len(weight), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(ids), min(COLUMNS, len(weight) - start)))
        dense[row[a:b], column[a:b] - start] = 1
        shared += (dense * weight[start:start + COLUMNS]) @ dense.T
    either = total[:, None] + total[None] - shared
    a, b = np.nonzero(np.triu(shared >= (threshold - SLACK) * either, 1))
    root = spanning_roots(a, b, len(ids))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[root[moved]], pa.int64())})


def near_duplicates(
    docs: DataFrame, workspace, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    idf_range: float = IDF_RANGE,
) -> DataFrame:
    """(id, class_id, kept): ``class_id`` is the smallest id that links reach, and ``kept`` marks that document.

    Words are runs without white space, in lower case; shingles are five words, or all words of a shorter text. A
    shingle weighs its count times 1 + ``idf_range`` ln((1 + N) / (1 + df)) / ln(1 + N), counted over all documents.
    Two documents are linked if their weighted Jaccard similarity is at least ``threshold``; candidates share a band
    of ``ROWS`` of ``BANDS`` (at a similarity of 0.8 all but 4 in 100,000 pairs do). Equal word sequences are one
    class before bands are compared. A bucket is cut into pieces that are compared two by two, so no bucket meets in
    one task, and tasks emit spanning links only.

    Texts without words, null ones too, are alone. A null id is alone, with a null class; an id that repeats is one
    document with all its texts. Texts are taken whole, however long; a pair right at the threshold is linked; of equal
    texts the smallest id stays. An empty table gives an empty result; extra columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_t"))
    n, n_docs = count_blocks(known, "_t"), known.count()
    texts = in_blocks(known, n, "_key", "_t")
    schema = pa.schema([("_id", pa.int64()), ("_class", pa.binary()), ("_bands", pa.list_(pa.int64())),
                        ("_elements", pa.binary()), ("_weights", pa.binary())])

    def ask(part: pa.Table) -> pa.Table:
        return Shingled(part, n).questions(part.column("_block")[0].as_py())

    asked = texts.groupBy("_block").applyInArrow(ask, "_shard int, _block int, _tags binary, _counts binary")
    answered = asked.groupBy("_shard").applyInArrow(add_up, "_block int, _shard int, _df binary")
    described = workspace.table(texts.groupBy("_block").cogroup(answered.groupBy("_block")).applyInArrow(
        lambda left, right: describe(left, right, n_docs, n, threshold, idf_range, schema),
        "_id long, _class binary, _bands array<long>, _elements binary, _weights binary"), "described")

    able = described.where(F.col("_class").isNotNull())
    classes = workspace.table(able.groupBy("_class").agg(
        F.min("_id").alias("_rep"), F.first("_bands", True).alias("_bands"),
        F.first("_elements", True).alias("_elements"), F.first("_weights", True).alias("_weights")), "classes")
    banded = classes.select("_class", F.explode("_bands").alias("_bucket"))
    buckets = banded.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "_bucket", F.ceil(F.col("_n") / PIECE).cast("int").alias("_pieces"))
    met = banded.join(buckets, "_bucket").withColumn("_own", F.pmod(F.xxhash64("_class"), "_pieces").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))
    paired = met.withColumn("_other", other).select(
        "_bucket", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_class")
    features = classes.select("_class", "_rep", "_elements", "_weights")
    links = workspace.table(paired.join(features, "_class").groupBy("_bucket", "_i", "_j").applyInArrow(
        lambda part: compare(part, threshold), "a long, b long"), "links")
    # Texts that share an id link their classes.
    same = able.groupBy("_id").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high")).where("_low <> _high")
    shared = able.join(same.select("_id"), "_id", "left_semi").select("_id", "_class").distinct().join(
        classes.select("_class", "_rep"), "_class").where("_id <> _rep").select(
        F.col("_id").alias("a"), F.col("_rep").alias("b"))
    comps = connected_components(links.unionByName(shared), workspace)

    named = able.select("_id", "_class").distinct().join(classes.select("_class", "_rep"), "_class")
    placed = named.join(comps.withColumnRenamed("node", "_rep"), "_rep", "left").groupBy("_id").agg(
        F.min(F.coalesce("component", "_rep")).alias("_to"))
    alone = described.where(F.col("_class").isNull()).groupBy("_id").agg(F.min("_id").alias("_to"))
    every = placed.unionByName(alone).groupBy("_id").agg(F.min("_to").alias("_to"))
    kind = docs.schema[id_col].dataType.simpleString()
    lone = docs.where(F.col(id_col).isNull()).select(
        id_col, F.lit(None).cast(kind).alias("class_id"), F.lit(True).alias("kept"))
    return every.select(F.col("_id").cast(kind).alias(id_col), F.col("_to").cast(kind).alias("class_id"),
                        (F.col("_id") == F.col("_to")).alias("kept")).unionByName(lone)
