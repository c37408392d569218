"""Reports on a corpus and its splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlcorpus import schemas as S

TOTAL = "Total"
UNKNOWN = "(unknown labels)"


def _named(level: Column) -> Column:
    """A label, or the name of the total where a roll-up has none."""
    return F.when(F.grouping(level) == 1, TOTAL).otherwise(level)


def level_distribution(df: DataFrame) -> DataFrame:
    """Rows and share by label, with a total row; a null label counts as other."""
    level = F.coalesce(F.col("level"), F.lit(S.LEVEL_OTHER))
    # A handful of labels is left for the roll-up and the window.
    counts = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("_n"))
    rolled = counts.rollup("level").agg(_named(F.col("level")).alias("_name"), F.sum("_n").alias("n"))
    total = F.max("n").over(Window.partitionBy())
    return rolled.select(F.col("_name").alias("level"), "n", (F.col("n") * 100.0 / total).alias("pct"))


def target_vs_filled(filled: DataFrame, quota: DataFrame) -> DataFrame:
    """Target, filled rows and percentage by split and label; totals count every filled row.

    ``quota`` has a few rows of ``split, level, target``.
    """
    level = F.coalesce(F.col("level"), F.lit(S.LEVEL_OTHER))
    held = filled.groupBy("split", level.alias("level")).agg(F.count(F.lit(1)).alias("_n"))

    def with_totals(df: DataFrame, value: Column) -> DataFrame:
        rolled = df.rollup("split", "level").agg(_named(F.col("level")).alias("_name"), value)
        return rolled.filter(F.col("split").isNotNull()).drop("level").withColumnRenamed("_name", "level")

    goals = with_totals(quota, F.sum("target").alias("target"))
    sums = with_totals(held, F.sum("_n").alias("_filled"))
    lines = goals.join(sums, ["split", "level"], "left").select(
        "split", "level", "target", F.coalesce("_filled", F.lit(0)).alias("filled")
    )
    pct = F.when(F.col("target") > 0, F.col("filled") * 100.0 / F.col("target")).otherwise(0.0)
    return lines.withColumn("pct_filled", pct)


def database_coverage(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of each expected database, and whether it has none."""
    counts = df.groupBy("db_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = expected.select("db_id").distinct().join(counts, "db_id", "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select("db_id", n.alias("n"), (n == 0).alias("missing"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """One row: covered and expected databases, and the percentage covered."""
    counts = coverage.agg(F.count_if(~F.col("missing")).alias("covered"), F.count(F.lit(1)).alias("total"))
    pct = F.when(F.col("total") > 0, F.col("covered") * 100.0 / F.col("total")).otherwise(0.0)
    return counts.withColumn("pct", pct)


def missing_databases(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected databases without a row."""
    return expected.select("db_id").distinct().join(df.select("db_id"), "db_id", "left_anti")


def sorted_report(report: DataFrame, by: str = "level") -> DataFrame:
    """A report in the order it is read: by name, the total last."""
    return report.orderBy(F.col(by) == TOTAL, by)


def format_distribution(report: DataFrame, title: str) -> str:
    """The distribution as a text table. Labels that the library does not know are one line, however many there are."""
    known = F.when(F.col("level").isin([*S.LEVELS, TOTAL]), F.col("level")).otherwise(UNKNOWN)
    rows = sorted_report(report.groupBy(known.alias("level")).agg(F.sum("n").alias("n"), F.sum("pct").alias("pct"))).collect()
    if not rows:
        return f"{title}: empty"
    return as_table(title, ["label", "rows", "share"], [(r["level"], r["n"], f"{r['pct']:.1f} %") for r in rows])


def as_table(title: str, heads: list[str], rows: list[tuple]) -> str:
    """A title and a Markdown table with columns as wide as their widest cell, numbers to the right."""
    cells = [heads, *[[str(cell) for cell in row] for row in rows]]
    widths = [max(len(line[i]) for line in cells) for i in range(len(heads))]
    lines = ["| " + " | ".join(
        cell.ljust(w) if i == 0 else cell.rjust(w) for i, (cell, w) in enumerate(zip(line, widths))) + " |"
        for line in cells]
    rule = "|" + "|".join("-" * (w + 2) if i == 0 else "-" * (w + 1) + ":" for i, w in enumerate(widths)) + "|"
    return "\n".join([f"**{title}**", "", lines[0], rule, *lines[1:]])


def format_target_vs_filled(report: DataFrame, split: str) -> str:
    """Targets of one split beside what it holds, as a text table."""
    rows = sorted_report(report.filter(F.col("split") == split)).collect()
    return as_table(split, ["label", "wanted", "held", "share"], [
        (r["level"], r["target"], r["filled"], f"{r['pct_filled']:.1f} %") for r in rows])


def format_coverage(coverage: DataFrame, title: str, folder: str) -> str:
    """Databases with and without rows, as a text table; ``folder`` gets a CSV file of all of them by name."""
    sorted_report(coverage, "db_id").select("db_id", F.col("n").alias("rows"), "missing").write.mode("overwrite").csv(
        folder, header=True)
    held = coverage_summary(coverage).first()
    covered, total = held["covered"], held["total"]
    return as_table(f"{title}: databases", ["", "databases", "share"], [
        ("with rows", covered, f"{held['pct']:.1f} %"),
        ("without rows", total - covered, f"{100 - held['pct'] if total else 0:.1f} %")])
