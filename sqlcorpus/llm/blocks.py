"""Blocks of whole documents and shards of digests, between which operators send packed arrays.

Documents are dealt into blocks by a hash of their id and text, so that ids that are null or repeat are spread, digests into shards by their leading bits. A block sends each
shard one row that packs all it has for it, so however often a digest occurs, a shard sees it once a block. Block
size grows with the square root of the corpus, so that messages stay longer than their overhead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BLOCK = 2 << 20
#: Bytes of a block for each block that there is, at least.
PER_MESSAGE = 512


def measure_blocks(docs: DataFrame, text_col: str) -> tuple[int, float]:
    """(blocks, bytes of one) for the bytes of all texts: about 2 MB each, more in a corpus of over 8 GB."""
    total = docs.select(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("binary")).cast("long"))).first()[0] or 0
    size = max(LEAST_BLOCK, (PER_MESSAGE * total) ** 0.5)
    return max(1, round(total / size)), size


def count_blocks(docs: DataFrame, text_col: str) -> int:
    return measure_blocks(docs, text_col)[0]


def in_blocks(docs: DataFrame, n_blocks: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(_id, _text as bytes, _block), and the columns ``carry`` as _rest."""
    return docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"),
        F.pmod(F.xxhash64(F.lit(7), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(n_blocks)).cast("int").alias("_block"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_rest")] if carry else []))


def shard_of(digest: np.ndarray, n_shards: int) -> np.ndarray:
    return ((digest >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def split_at(sorted_shards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, start, end) of each run of equal shards."""
    if not len(sorted_shards):
        return (np.zeros(0, dtype=np.int64),) * 3
    starts = np.flatnonzero(np.concatenate([[True], sorted_shards[1:] != sorted_shards[:-1]]))
    return sorted_shards[starts], starts, np.append(starts[1:], len(sorted_shards))
