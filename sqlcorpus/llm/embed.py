"""Near-duplicates among embeddings through an inverted multi-index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from sqlcorpus.llm.components import connected_components

#: Vectors of one block of a cell, and queries compared with a block at once.
BLOCK_HOMES, BLOCK_QUERIES = 1024, 2048
#: Rows that the index is fitted on at most, queries whose recall is measured, and the recall to reach.
SAMPLE_ROWS, RECALL_QUERIES, TARGET_RECALL = 12_000, 1500, 0.999


@dataclass
class MultiIndex:
    """A codebook for each half of the vectors; a cell is a pair of centroids, and a query visits ``visits`` cells."""

    halves: tuple[np.ndarray, np.ndarray]
    visits: int

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Cells by distance, nearest first: what the multi-sequence walk over both sorted distance lists yields.

        The walk pops the pair (i, j) of ranks only after all pairs below it, so the first T pairs have
        (i + 1)(j + 1) <= T; these pairs are ranked by their sums for all rows at once.
        """
        k = [len(h) for h in self.halves]
        cut = x.shape[1] // 2
        ranked = []
        for part, book in ((x[:, :cut], self.halves[0]), (x[:, cut:], self.halves[1])):
            d = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None]
            near = np.argsort(d, axis=1, kind="stable")[:, :visits]
            ranked.append((near, np.take_along_axis(d, near, axis=1)))
        (a, da), (b, db) = ranked
        pairs = np.array([(i, j) for i in range(a.shape[1]) for j in range(min(b.shape[1], visits // (i + 1)))])
        total = da[:, pairs[:, 0]] + db[:, pairs[:, 1]]
        first = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return a[np.arange(len(x))[:, None], pairs[first, 0]].astype(np.int64) * k[1] + b[
            np.arange(len(x))[:, None], pairs[first, 1]]


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * x @ book.T + (book * book).sum(1)[None]).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def fit_index(sample: np.ndarray, n_rows: int, threshold: float, seed: int = 3) -> MultiIndex:
    """Codebooks from a sample of unit vectors, and the visits that find ``TARGET_RECALL`` of its linked pairs.

    Both grow with the table: about one cell for 256 rows. Recall is measured against brute force over the sample and
    over noisy copies of its rows at the threshold itself, so that tables without linked pairs are served as well.
    """
    rng = np.random.default_rng(seed)
    k = int(np.clip(round((n_rows / 256) ** 0.5), 1, max(1, len(sample) // 8)))
    cut = sample.shape[1] // 2
    index = MultiIndex((k_means(sample[:, :cut], k, rng), k_means(sample[:, cut:], k, rng)), 1)
    queries = sample[rng.choice(len(sample), min(RECALL_QUERIES, len(sample)), replace=False)]
    noise = rng.normal(size=queries.shape)
    noise -= (noise * queries).sum(1, keepdims=True) * queries
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    planted = threshold * queries + (1 - threshold ** 2) ** 0.5 * noise
    visits = min(k * k, 4)
    while True:
        home = index.order(sample, 1)[:, 0]
        cells, back = index.order(queries, visits), index.order(planted, visits)
        found = total = 0
        for s in range(0, len(queries), 500):
            q, x = np.nonzero(queries[s:s + 500] @ sample.T >= threshold)
            total += len(q)
            found += int((cells[s + q] == home[x][:, None]).any(1).sum())
        far = index.order(planted, 1), index.order(queries, 1)
        met = (cells == far[0]).any(1) | (back == far[1]).any(1)
        if visits >= k * k or (found >= TARGET_RECALL * total and met.mean() >= TARGET_RECALL):
            return MultiIndex(index.halves, visits)
        visits = min(k * k, visits * 2)


def _linked_by_index(classes: DataFrame, workspace, threshold: float, size: int) -> DataFrame:
    """(_rep, _links, _root) of classes of one length that share cells of an index."""
    spark, kind = classes.sparkSession, classes.schema["_v"].dataType.simpleString()
    picked = classes.orderBy(F.xxhash64("_key", "_rep")).limit(SAMPLE_ROWS).select("_v").toPandas()
    sample = np.array(picked["_v"].tolist(), dtype=np.float64).reshape(-1, size)
    index = fit_index(unit(sample), classes.count(), threshold)
    held = spark.sparkContext.broadcast(index)  # k * k is about n / 256, so 2 k centroids stay small

    label = classes.schema["_label"].dataType.simpleString()

    def place(batches):
        own = held.value
        for part in batches:
            if len(part):
                x = unit(np.array(part["_v"].tolist(), dtype=np.float64))
                cells = own.order(x, own.visits)
                yield part.assign(_home=cells[:, 0], _cells=list(cells))

    placed = workspace.table(classes.select("_rep", "_label", "_n", "_v").mapInPandas(
        place, f"_rep long, _label {label}, _n long, _v {kind}, _home long, _cells array<long>"), "placed")
    # Only a home's own walk is looked up, so queries travel without theirs.
    visits = placed.withColumn("_cell", F.explode("_cells")).withColumn("_cells", F.lit(None).cast("array<long>"))
    homes = placed.groupBy("_label", F.col("_home").alias("_cell")).agg(F.count(F.lit(1)).alias("_homes"))
    counts = workspace.table(visits.groupBy("_label", "_cell").agg(F.count(F.lit(1)).alias("_queries")).join(
        homes, ["_label", "_cell"]).select(
        "_label", "_cell", F.ceil(F.col("_homes") / BLOCK_HOMES).cast("int").alias("_hs"),
        F.ceil(F.col("_queries") / BLOCK_QUERIES).cast("int").alias("_qs")), "cells")

    def blocks(side: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("_rep"), F.col(own)).cast("int")
        there = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        both = side.join(counts, ["_label", "_cell"]).withColumn(own, mine).withColumn(other, there)
        return both.select("_label", "_cell", "_hs", "_qs", F.lit(query).alias("_query"), "_rep", "_n", "_v", "_home",
                           "_cells")

    met = blocks(visits, "_qs", "_hs", True).unionByName(
        blocks(placed.withColumn("_cell", F.col("_home")), "_hs", "_qs", False))

    def link(part: pd.DataFrame) -> pd.DataFrame:
        q, h = part[part["_query"]], part[~part["_query"]]
        if not len(q) or not len(h):
            return pd.DataFrame({"_rep": [], "_links": [], "_root": []}).astype("int64")
        cosine = unit(np.array(q["_v"].tolist(), dtype=np.float64)) @ unit(np.array(h["_v"].tolist(), dtype=np.float64)).T
        a, b = np.nonzero((cosine >= threshold) & (q["_rep"].to_numpy()[:, None] != h["_rep"].to_numpy()[None]))
        # The other way round, the pair meets in the query's home if the home's own walk gets there.
        reach, at = np.array(h["_cells"].tolist()), q["_home"].to_numpy()
        mutual = np.zeros(len(a), dtype=bool)
        for s in range(0, len(a), 1 << 18):
            part_a, part_b = a[s:s + (1 << 18)], b[s:s + (1 << 18)]
            mutual[s:s + (1 << 18)] = (reach[part_b] == at[part_a][:, None]).any(1)
        one = ~mutual
        nq, nh = q["_n"].to_numpy(), h["_n"].to_numpy()
        ids = np.concatenate([q["_rep"].to_numpy(), h["_rep"].to_numpy()])
        links = np.concatenate([np.bincount(a, weights=nh[b], minlength=len(q)),
                                np.bincount(b[one], weights=nq[a[one]], minlength=len(h))]).astype(np.int64)
        nodes, inverse = np.unique(ids, return_inverse=True)
        root = spanning_roots(inverse[a], inverse[len(q) + b], len(nodes))
        total = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(total, inverse, links)
        linked = (total > 0) | (root != np.arange(len(nodes)))
        return pd.DataFrame({"_rep": nodes[linked], "_links": total[linked], "_root": nodes[root[linked]]})

    return met.groupBy("_label", "_cell", "_hs", "_qs").applyInPandas(link, "_rep long, _links long, _root long")


def _links_within(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(_rep, _links, _root) of classes that are few: each is compared with each."""
    x, reps, n = unit(np.array(part["_v"].tolist(), dtype=np.float64)), part["_rep"].to_numpy(), part["_n"].to_numpy()
    cosine = x @ x.T
    np.fill_diagonal(cosine, -1)
    a, b = np.nonzero(cosine >= threshold)
    nodes, inverse = np.unique(reps, return_inverse=True)
    apart = inverse[a] != inverse[b]
    a, b = a[apart], b[apart]
    links = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(links, inverse[a], n[b])
    root = spanning_roots(inverse[a], inverse[b], len(nodes))
    linked = links > 0
    return pd.DataFrame({"_rep": nodes[linked], "_links": links[linked], "_root": nodes[root[linked]]})


def near_vectors(
    vectors: DataFrame, workspace, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: cosine >= ``threshold`` inside a label links two vectors.

    Equal vectors of a label become one class first. A class lives in the cell of its nearest centroids and, as a
    query, visits its nearest cells of the same label; each pair that meets is verified in double precision. A pair
    is counted once for both of its ends, also if only one of them visits the other. Cells and their queries are cut
    into blocks, so no cell meets in one task, and a task emits sums and a spanning set of links, never pairs.
    Vectors of different lengths never link. The most frequent length, and any other of over ``BLOCK_HOMES`` classes,
    has an index of its own; the classes of all others, which are one block a label and length, are compared with each
    other directly.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without a
    label or id, which stay rows of the result; rows with the same id count as one node with all their links, copies of
    a vector link with each other, and a pair right at the threshold is a link. An empty table gives an empty result.
    Extra columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    # Floats travel as they are and are widened where they are compared.
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType)
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"),
                          F.col(vector_col).cast(kind).alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("_label").isNotNull() & F.col("_id").isNotNull() & F.col("_v").isNotNull() & finite & F.exists(
        "_v", lambda x: x != 0)
    good = workspace.table(rows.where(usable).withColumn(
        "_key", F.xxhash64(F.lit(1), "_v")).withColumn("_key2", F.xxhash64(F.lit(2), "_v")), "vectors")
    classes = workspace.table(good.groupBy("_label", "_key", "_key2", "_v").agg(
        F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")), "classes")
    n_rows = classes.count()
    lone = lambda df: df.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                                F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    if n_rows == 0:
        return lone(rows)

    counts = classes.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d")
    most = counts.first()["d"]
    lengths = [r["d"] for r in counts.where((F.col("count") > BLOCK_HOMES) | (F.col("d") == most)).collect()]
    parts = [_linked_by_index(classes.where(F.size("_v") == d), workspace, threshold, d) for d in lengths]
    rest = classes.where(~F.size("_v").isin(lengths))
    parts.append(rest.groupBy("_label", F.size("_v")).applyInPandas(
        lambda part: _links_within(part, threshold), "_rep long, _links long, _root long"))
    found = workspace.table(reduce(DataFrame.unionByName, parts), "links")
    comps = connected_components(found.select(F.col("_rep").alias("a"), F.col("_root").alias("b")), workspace)
    summed = found.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    reps = classes.select("_label", "_key", "_key2", "_rep", "_n").join(summed, "_rep", "left").join(
        comps.withColumnRenamed("node", "_rep"), "_rep", "left")
    # Copies of a vector share its links and its component.
    named = good.join(reps, ["_label", "_key", "_key2"], "left").groupBy("_id").agg(
        F.sum(F.coalesce("_n", F.lit(1)) - 1 + F.coalesce("_links", F.lit(0))).alias("_links"),
        F.min(F.coalesce("component", "_rep", "_id")).alias("_component"))
    linked = named.select(F.col("_id").alias(id_col), F.col("_links").cast("long").alias("n_links"),
                          F.col("_component").alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept"))
    return linked.unionByName(lone(rows.where(~F.coalesce(usable, F.lit(False)))))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, scaled by the largest component first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spanning_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the links (a, b): hooking and halving until nothing moves."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root
