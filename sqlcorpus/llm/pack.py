"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.bpe import PieceEncoder
from sqlcorpus.llm.common import per_batch

#: Pieces that one task packs together on average; the number of groups follows from the number of pieces.
GROUP_PIECES = 4096


def sum_of_squares(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of every length, taken in order, each put where the squares of the counts of open bins by gap sum least.

    A bin of gap g that takes s changes the sum by 2 (N[g - s] - N[g]) + 2, or 1 - 2 N[g] if it gets full; a new one
    by 2 N[size - s] + 1. Ties go to the smallest gap, a new bin last.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    out, made = np.empty(len(lengths), dtype=np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gap = size
        if s < size:
            have = counts[s:size]
            change = 2 * (counts[:size - s] - have) + 2
            change[0] = 1 - 2 * have[0]
            change = np.where(have > 0, change, np.iinfo(np.int64).max)
            best = int(change.argmin())
            if change[best] <= 2 * counts[size - s] + 1:
                gap = best + s
        if gap == size:
            number, made = made, made + 1
        else:
            number = open_bins[gap].pop()
            counts[gap] -= 1
        out[k] = number
        if gap > s:
            counts[gap - s] += 1
            open_bins[gap - s].append(number)
    return out


def pack_lengths(lengths: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """``sum_of_squares`` from the longest on; bins that are not full are then dissolved and packed anew while it helps."""
    out = np.empty(len(lengths), dtype=np.int64)
    left, made = np.argsort(-lengths, kind="stable"), 0
    best: np.ndarray | None = None
    for k in range(rounds):
        rng = np.random.default_rng(k)
        noise = np.zeros(len(left)) if k == 0 else rng.uniform(0, 0.15 * k, len(left))
        order = left[np.argsort(-(lengths[left] * (1 + noise)), kind="stable")]
        bins = sum_of_squares(lengths[order], size)
        n = int(bins.max()) + 1 if len(bins) else 0
        if best is None or n <= best_n:
            best, best_n, best_order = bins, n, order
            full = np.bincount(best, weights=lengths[best_order], minlength=n) == size
            done = full[best]
            names = np.cumsum(full) - 1
            out[best_order[done]] = made + names[best[done]]
            made += int(full.sum())
            left = best_order[~done]
            renamed = np.cumsum(~full) - 1
            best, best_order, best_n = renamed[best[~done]], left, n - int(full.sum())
    out[best_order] = made + best
    return out


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: all full but the first."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pack_documents(
    docs: DataFrame, workspace, path: str, size: int = 2048, ids: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: (id, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` its token ids too.

    A document is its text's ids and the id 0, so a null or empty text is one token. Full pieces are sequences of
    their own; the others, one a document at most, are dealt into groups by a hash and each group is packed by
    ``pack_lengths``. The number of groups follows from the number of documents, and a group wastes a sequence or
    so. Rows with the same id, or none, are packed like others and told apart by nothing but the place of their row.
    Pieces are stored before they are packed, so texts are encoded once; long texts are taken whole, in pieces. Equal
    lengths are packed in any order. An empty table gives an empty result; extra columns are not read, whatever their
    names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    blob = ", _ids binary" if ids else ""

    def make():
        encoder = PieceEncoder(path)

        def work(batch: pa.RecordBatch) -> dict:
            rows, places = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                tokens = encoder.encode(text or "") + b"\0\0\0\0"
                for i, (start, length) in enumerate(cut_pieces(len(tokens) // 4, size)):
                    part = tokens[4 * start:4 * (start + length)]
                    rows.append((i, start, length, zlib.crc32(part), part if ids else None))
                    places.append(k)
            piece, start, length, crc, part = zip(*rows) if rows else ((),) * 5
            return {id_col: batch.column(0).take(pa.array(places, pa.int32())), "piece": piece, "start": start,
                    "length": length, "ids_crc32": crc, "_row": batch.column(2).take(pa.array(places, pa.int32())), "_ids": part}
        return work

    columns = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _row long{blob}"
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.monotonically_increasing_id())
    pieces = workspace.table(per_batch(rows, make, columns), "pieces")
    full = pieces.where(F.col("length") == size).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))

    loose = pieces.where(F.col("length") < size)
    groups = -(-max(loose.count(), 1) // GROUP_PIECES)
    # The number of the stored row spreads rows that share an id, or have none, and their text.
    group = F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([id_col, "length", "ids_crc32", "_row"], kind="stable").reset_index(drop=True)
        bins = pack_lengths(part["length"].to_numpy(), size)
        part["sequence_id"] = part["_group"] * (1 << 32) + bins
        lengths = part.groupby("sequence_id")["length"]
        part["offset"] = lengths.cumsum() - part["length"]
        return part.drop(columns="_group")

    packed = loose.withColumn("_group", group).groupBy("_group").applyInPandas(
        pack, columns + ", sequence_id long, offset long")
    out = full.unionByName(packed).drop("_row")
    return out.withColumnRenamed("_ids", "ids") if ids else out
