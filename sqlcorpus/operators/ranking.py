"""Exact ranks over huge groups, without one task ever holding a group.

There are five labels, so a window partitioned by label would put a fifth of the corpus, or far
more, into one task. Ranks are found in two steps instead: count the rows of each key bucket,
turn the counts into bucket offsets, and rank only inside buckets. With a limit, buckets that
lie wholly beyond it are dropped before anything is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Leading hex digits of a sampling key that make up its bucket: 16**3 buckets a group.
BUCKET_DIGITS = 3


def _offsets(df: DataFrame, groups: list[str]) -> DataFrame:
    """Rows before each bucket of its group, and rows of the group: one row a (group, bucket)."""
    group = Window.partitionBy(*groups)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(
        *groups,
        "_bucket",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )


def rank_by_key(
    df: DataFrame,
    key: str,
    groups: list[str] = (),
    ties: list[str] = (),
    limit: Column | int | None = None,
    total: str | None = None,
    rank: str = "rank",
    digits: int = BUCKET_DIGITS,
    between: DataFrame | None = None,
) -> DataFrame:
    """The 1-based rank of each row in its group by a hex key, for ranks up to ``limit``.

    The result has the columns ``groups``, ``ties``, ``key`` and ``rank``. ``limit`` may be a column of the groups, if
    they are few (labels, domains). For any number of groups ``between`` is a table with their columns, ``first`` and
    ``last``: only ranks between these are returned, and only of the groups it names. What it leaves out of a group is
    dropped by bucket, before rows are shuffled. ``total`` names a column
    for the size of the group. Equal to ``row_number() over (partition by groups order by key,
    ties)``. Distinct keys must spread evenly, as digests do; copies of a row are counted before
    they are shuffled, so a row may be repeated any number of times.
    """
    group_by = list(groups) or ["_all"]
    columns = list(dict.fromkeys([*group_by, *ties, key]))
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    bucketed = df.select(*columns, F.substring(key, 1, digits).alias("_bucket"))
    offsets = _offsets(bucketed, group_by)
    least = F.lit(1)
    if between is not None:
        names = between.select(*groups, F.col("first").alias("_least"), F.col("last").alias("_most"))
        offsets = offsets.join(names, list(groups)).filter("_before < _most AND _before + _n >= _least")
        least, limit = F.col("_least"), F.col("_most")
    elif limit is not None:
        limit = F.lit(limit) if isinstance(limit, int) else limit
        offsets = offsets.filter(F.col("_before") < limit)
    # At most 16**digits rows a group; that groups are few is the caller's word, so their size decides.
    kept = bucketed.join(offsets, [*group_by, "_bucket"])
    bounds = ["_least", "_most"] if between is not None else []
    distinct = kept.groupBy(*columns, "_bucket", "_before", "_total", *bounds).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    inside = Window.partitionBy(*group_by, "_bucket").orderBy(key, *ties)
    last = F.col("_before") + F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = distinct.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_copies") + 1)
    if limit is not None:
        ranked = ranked.filter((F.col("_first") <= limit) & (F.col("_last") >= least)).withColumns({
            "_first": F.greatest("_first", least.cast("bigint")), "_last": F.least("_last", limit.cast("bigint"))})
    if total:
        columns.append(F.col("_total").alias(total))
    out = ranked.select(*columns, F.explode(F.sequence("_first", "_last")).alias(rank))
    return out.drop("_all")


def rank_few(
    df: DataFrame, key: str, groups: list[str] = (), ties: list[str] = (),
    limit: Column | int | None = None, rank: str = "rank",
) -> DataFrame:
    """``rank_by_key`` for rows known to be few enough for one task a group: a single window."""
    window = Window.partitionBy(*groups).orderBy(key, *ties)
    columns = list(dict.fromkeys([*groups, *ties, key]))
    ranked = df.select(*columns, F.row_number().over(window).cast("bigint").alias(rank))
    return ranked if limit is None else ranked.filter(F.col(rank) <= limit)


def rank_by_order(
    df: DataFrame, order_by: str, rank: str = "rank", buckets: int | None = None, rows: int = 200_000
) -> DataFrame:
    """Add the 1-based rank of each row by a number, date or timestamp column; nulls come last.

    Quantiles of the column split the rows into even ranges of about ``rows`` rows; the split points
    become constants of the plan, so repeated or recovered tasks place every row alike. Rows without
    a value, and ties, are ordered by a digest of the row. A value that fills several ranges stands in as many
    split points: its rows are divided by digest into that many buckets of their own, as are rows without a value, so
    that no value is a bucket however often it occurs.
    """
    if buckets is None:
        buckets = df.count() // rows + 1
    kind = df.schema[order_by].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raise TypeError(f"{order_by} must be a number, date or timestamp")
    value = F.col(order_by).cast("timestamp") if isinstance(kind, T.DateType) else F.col(order_by)
    placed = df.withColumn("_order", value.cast("double")).withColumn(
        "_digest", F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]))]))
    probabilities = [position / buckets for position in range(1, buckets)]
    error = 1 / (5 * buckets)
    found = placed.select("_order").stat.approxQuantile("_order", probabilities, error) if probabilities else []
    times = Counter(found)
    values = sorted(times) or [0.0]
    splits = [-math.inf, *values, math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol="_order", outputCol="_range", handleInvalid="keep")
    # Of range i its first value, a split point, comes before the others, in ``parts[i]`` buckets by digest.
    parts = [1, *(times[v] + 1 if times[v] > 1 else 1 for v in values)]
    starts = [0, *accumulate(n + 1 for n in parts)]
    at = F.col("_range").cast("int") + 1
    points, sizes, bases = (F.array(*map(F.lit, x)) for x in ([-math.inf, *values], parts, starts))
    # The digest as a fraction of its range, in order; 2**32 steps of it are enough.
    step = F.shiftright("_digest", 32) + F.lit(1 << 31)
    own = F.element_at(bases, at)
    many = F.element_at(sizes, at).cast("bigint")
    part = F.when(F.col("_order") == F.element_at(points, at), F.shiftright(step * many, 32)).otherwise(many)
    spread = F.lit(starts[-1]) + F.shiftright(step * F.lit(buckets).cast("bigint"), 32)
    valued = F.col(order_by).isNotNull()
    placed = bucketizer.transform(placed).withColumn(
        "_bucket", F.when(valued & (at <= len(parts)), own + part).otherwise(spread).cast("bigint"))
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # Values of ranges may lie between doubles, so rows are ordered by the column itself.
    inside = Window.partitionBy("_bucket").orderBy(F.col(order_by).asc_nulls_last(), "_digest")
    # One row a bucket, and a bucket is ``rows`` rows.
    ranked = placed.join(offsets, "_bucket")
    return ranked.withColumn(rank, F.col("_before") + F.row_number().over(inside)).drop(
        "_bucket", "_before", "_order", "_digest", "_range"
    )
