"""Proportional stratified interleaving: shards that each hold the mixture of sources of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a ranking holds on average; the number of buckets follows from the row count.
BUCKET_ROWS = 512


def bucket_bits(n_rows: int) -> int:
    """Bits of the bucket number, so that a bucket holds about ``BUCKET_ROWS`` rows."""
    return max(0, (max(n_rows, 1) // BUCKET_ROWS).bit_length())


def bucket_offsets(counts: DataFrame, group: list[str], bits: int) -> DataFrame:
    """(group, _bucket, _n) to (group, _bucket, _before): rows in the smaller buckets of the group.

    Sums run in two levels, over coarse buckets and inside each, so that a large group is no single long sum.
    """
    counts = counts.withColumn("_coarse", F.shiftright("_bucket", (bits + 1) // 2))
    fine = Window.partitionBy(*group, "_coarse").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    coarse = Window.partitionBy(*group).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_n")).select(
        *group, "_coarse", F.coalesce(F.sum("_n").over(coarse), F.lit(0)).alias("_base"))
    inside = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(fine), F.lit(0)))
    return inside.join(totals, [*group, "_coarse"]).select(
        *group, "_bucket", (F.col("_base") + F.col("_inside")).alias("_before"))


def interleave_shards(
    docs: DataFrame, n_shards: int, seed: str = "0", id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Deal all rows into ``n_shards`` shards whose row counts differ by one at most and whose mixtures agree.

    Rows of a source are ranked by a seeded digest of their id, size and checksum; rank r of n, from 0, gets the
    fraction (r + u) / n, where u is a seeded number between 0 and 1 for each source, so that sources of one row spread
    over the whole order like the rows of large ones; rows in order of their fractions are cut into equal runs. Ranks
    come from bucket counts and a sort inside each bucket, so neither a hot source, nor thousands of small ones, nor
    an id that many rows share meet in one task. A null source is a source of its own, a null text is empty, however
    long a text is only its size and checksum travel, a null id is ranked as empty text; rows that repeat are rows of
    their own and rows equal in all of these are dealt in any order. An empty table gives an empty result; extra
    columns are not read, whatever their names. Returns (id, source, size, text_crc32, shard, slot): UTF-8 bytes plus
    8, and the place in the shard.
    """
    def digest(digits: int, *parts) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, digits), 16, 10).cast("long")

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        ident.alias("_ident"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")).alias("_stratum"),
        (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text).alias("_crc"),
    ).withColumn("_key", digest(15, "_ident", F.col("_size").cast("string"), F.col("_crc").cast("string"))).drop("_ident")
    n = docs.count()
    bits = bucket_bits(n)

    keyed = rows.withColumn("_bucket", F.shiftright("_key", 60 - bits))
    counts = keyed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("_stratum").agg(F.sum("_n").alias("_total"))
    before = bucket_offsets(counts, ["_stratum"], bits).join(totals, "_stratum")
    within = Window.partitionBy("_stratum", "_bucket").orderBy("_key", "_id", "_size", "_crc")
    ranked = keyed.withColumn("_r", F.row_number().over(within)).join(before, ["_stratum", "_bucket"])
    offset = (digest(8, "_stratum") + F.lit(0.5)) / F.lit(float(1 << 32))
    fraction = (F.col("_before") + F.col("_r") - 1 + offset) / F.col("_total")
    dealt = ranked.select(
        "_id", "_source", "_stratum", "_size", "_crc", "_key", fraction.alias("_fraction"),
        F.floor(fraction * (1 << bits)).cast("long").alias("_bucket"))

    places = bucket_offsets(dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), [], bits)
    order = Window.partitionBy("_bucket").orderBy("_fraction", "_stratum", "_key", "_id", "_size", "_crc")
    placed = dealt.withColumn("_r", F.row_number().over(order)).join(places, "_bucket").withColumn(
        "_place", F.col("_before") + F.col("_r") - 1)
    shard = F.expr(f"_place * {n_shards} div {max(n, 1)}").cast("int")
    return placed.withColumn("_shard", shard).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"),
        (F.col("_place") - F.expr(f"(_shard * {n}L + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"))
