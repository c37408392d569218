"""How many rows each label of a split should get, has, and still needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcorpus import schemas as S


def target_counts(
    sizes: DataFrame,
    size: str = "size",
    shares: dict[str, float] = S.LEVEL_SHARES,
    strict_compat: bool = False,
) -> DataFrame:
    """One row a label for every row of ``sizes``: its columns, the label and its target.

    Shares are rounded half to even; what is left over is handed out one by one, to the smallest
    targets first when rows are missing and from the largest first when there are too many, with
    the declared order between equals. Labels without a share stay at zero unless
    ``strict_compat`` lets them take part.
    """
    names = list(shares)
    total = F.col(size).cast("bigint")
    rounded = F.array(*[F.bround(F.lit(float(shares[name])) * total, 0).cast("bigint") for name in names])
    places = F.array(*[F.lit(i) for i, name in enumerate(names) if strict_compat or shares[name] > 0])
    rest = total - F.aggregate("_rounded", F.lit(0).cast("bigint"), lambda x, y: x + y)
    step = F.signum("_rest").cast("bigint")
    by_size = F.array_sort(
        F.transform(places, lambda i: F.struct((step * F.get("_rounded", i)).alias("n"), i.alias("i")))
    )
    order = F.transform(by_size, lambda entry: entry["i"])
    amount, many = F.abs("_rest"), F.size(places)

    def line(name: Column, i: Column) -> Column:
        place = F.array_position("_order", i)
        more = F.floor(amount / many).cast("bigint") + (place <= F.pmod(amount, many)).cast("bigint")
        target = F.get("_rounded", i) + F.when(place > 0, step * more).otherwise(0)
        return F.struct(name.alias("level"), target.alias("target"))

    staged = sizes.withColumn("_rounded", rounded).withColumn("_rest", rest).withColumn("_order", order)
    lines = F.transform(F.array(*[F.lit(name) for name in names]), line)
    return staged.select(*sizes.columns, F.inline(lines))


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows known to the driver, as constants of the plan."""
    kinds = [field.split() for field in schema.split(", ")]
    structs = [
        F.struct(*[F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(row, kinds)]) for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def split_targets(
    spark: SparkSession, sizes: dict[str, int], shares: dict[str, float] = S.LEVEL_SHARES,
    strict_compat: bool = False,
) -> dict[str, dict[str, int]]:
    """Targets by split and label, as plain numbers: at most labels times splits of them."""
    asked = small_frame(spark, list(sizes.items()), "split string, size bigint")
    targets = {split: {} for split in sizes}
    for row in target_counts(asked, "size", shares, strict_compat).collect():
        targets[row["split"]][row["level"]] = row["target"]
    return targets


def quota_frame(spark: SparkSession, targets: dict[str, dict[str, int]]) -> DataFrame:
    """Targets by split and label as a table of a few rows."""
    rows = [(split, level, n) for split, levels in targets.items() for level, n in levels.items()]
    return small_frame(spark, rows, "split string, level string, target bigint")


def filled_counts(filled: DataFrame, by: list[str] = ("split", "level")) -> DataFrame:
    """Rows held by split and label."""
    return filled.groupBy(*by).agg(F.count(F.lit(1)).alias("filled"))


def pending(quota: DataFrame, filled: DataFrame) -> DataFrame:
    """Rows still needed by split and label, for every entry of the quota."""
    held = filled_counts(filled)
    need = F.greatest(F.col("target") - F.coalesce("filled", F.lit(0)), F.lit(0))
    return (
        quota.join(held, ["split", "level"], "left")
        .select("split", "level", "target", F.coalesce("filled", F.lit(0)).alias("filled"), need.alias("need"))
    )


def unfilled_levels(needed: DataFrame) -> DataFrame:
    """Labels that any split still needs rows of, from ``pending``."""
    return needed.filter(F.col("need") > 0).select("level").distinct()
