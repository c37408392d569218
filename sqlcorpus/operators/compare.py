"""Equality of query results as sets of rows, for all pairs of statements at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.functions.cells import canonical_cell

GOLD, PRED = "gold", "pred"


def result_rows(df: DataFrame, pair_id: Column, side: Column | str, cells: list[str]) -> DataFrame:
    """Query output as ``pair_id, side, row``, with cells in canonical text."""
    side = F.lit(side) if isinstance(side, str) else side
    row = [canonical_cell(F.col(name), df.schema[name].dataType) for name in cells]
    return df.select(
        pair_id.cast("string").alias("pair_id"),
        side.alias("side"),
        F.array(*row).alias("row") if row else F.array().cast("array<string>").alias("row"),
    )


def compare_results(rows: DataFrame, executions: DataFrame) -> DataFrame:
    """Compare gold and predicted rows of every pair.

    ``executions`` has one row a pair: ``pair_id, gold_ok, pred_ok``, and optionally
    ``gold_cols, pred_cols, error_msg``. Order and duplicates of rows do not matter, nor do column
    names; order of columns does. Nulls equal each other. A pair without rows on either side
    matches if both statements ran. If a statement failed, nothing matches and all counts are zero.

    Rows are first merged by (pair, 128-bit digest of the row), which spreads even one huge pair over the cluster, and
    then summed by pair with partial sums on the map side.
    """
    gold, pred = F.col("side") == GOLD, F.col("side") == PRED
    digest = F.unhex(F.md5(F.to_json("row")))
    merged = rows.select("pair_id", "side", digest.alias("_row"), F.size("row").alias("_width")).groupBy(
        "pair_id", "_row", "_width"
    ).agg(F.count_if(gold).alias("_gold"), F.count_if(pred).alias("_pred"))
    width = F.col("_width")
    by_pair = merged.groupBy("pair_id").agg(
        F.bool_and((F.col("_gold") > 0) & (F.col("_pred") > 0)).alias("_equal"),
        F.sum("_gold").alias("_gold_rows"),
        F.sum("_pred").alias("_pred_rows"),
        F.max(F.when(F.col("_gold") > 0, width)).alias("_gold_cols"),
        F.max(F.when(F.col("_pred") > 0, width)).alias("_pred_cols"),
    )
    both = F.coalesce("gold_ok", F.lit(False)) & F.coalesce("pred_ok", F.lit(False))

    def counted(name: str, kind: str) -> Column:
        return F.when(both, F.coalesce(name, F.lit(0))).otherwise(0).cast(kind)

    def given(name: str) -> Column:
        empty = F.array().cast("array<string>")
        if name not in executions.columns:
            return empty
        return F.when(both, F.coalesce(name, empty)).otherwise(empty)

    error = F.col("error_msg") if "error_msg" in executions.columns else F.lit(None).cast("string")
    gold_ok = F.coalesce("gold_ok", F.lit(False))
    return executions.join(by_pair, "pair_id", "left").select(
        "pair_id",
        gold_ok.alias("gold_exec_status"),
        both.alias("predict_exec_status"),
        (both & F.coalesce("_equal", F.lit(True))).alias("match_status"),
        counted("_gold_rows", "bigint").alias("num_gold_rows"),
        counted("_pred_rows", "bigint").alias("num_predicted_rows"),
        counted("_gold_cols", "int").alias("num_gold_cols"),
        counted("_pred_cols", "int").alias("num_predicted_cols"),
        given("gold_cols").alias("gold_cols"),
        given("pred_cols").alias("predicted_cols"),
        F.when(gold_ok, error).alias("error_msg"),
    )


def set_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether two tables of equal width hold the same set of rows."""
    sides = left.withColumn("_side", F.lit(0)).union(right.withColumn("_side", F.lit(1)))
    rows = sides.groupBy(*left.columns).agg((F.min("_side") == F.max("_side")).alias("_single"))
    return rows.agg((F.count_if("_single") == 0).alias("equal"))
