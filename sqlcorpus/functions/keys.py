"""Sampling keys: a seeded pseudo-random order that no partitioning can change."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def shuffle_key(row_id: Column, seed: int = 42) -> Column:
    """Hex text whose order is a seeded shuffle of the ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))))
