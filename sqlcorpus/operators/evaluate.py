"""Accuracy of predicted statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.functions.text import exact_match, extract_sql


def _percent(hit: Column) -> Column:
    hits, total = F.count_if(hit), F.count(F.lit(1))
    return F.when(total > 0, hits * 100.0 / total).otherwise(0.0)


def _bare(sql: Column) -> Column:
    """A statement without white space around it and without closing semicolons."""
    return F.regexp_replace(sql, r"(?U)^\s+|[\s;]+$", "")


def join_references(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Predictions beside the statements they should equal, by question."""
    return predictions.join(references, "question_id")


def evaluate(
    predictions: DataFrame,
    comparisons: DataFrame,
    by: list[str] = (),
    raw: bool = False,
    gold: str = "gold_sql",
    predicted: str = "predicted_sql",
) -> DataFrame:
    """Exact-match and execution accuracy in percent of all samples, and the failures.

    ``predictions`` holds ``question_id``, the two statements and the ``by`` columns;
    ``comparisons`` holds ``question_id, gold_exec_status, predict_exec_status, match_status``. A
    failed gold statement counts as a failed prediction too. Texts are compared as extracted
    statements, or with ``raw`` as they stand.
    """
    text = F.col(predicted) if raw else _bare(extract_sql(F.col(predicted)))
    wanted = F.col(gold) if raw else _bare(F.col(gold))
    scored = predictions.select(
        "question_id", *by, F.coalesce(exact_match(text, wanted), F.lit(False)).alias("_exact")
    )
    outcome = comparisons.select("question_id", "gold_exec_status", "predict_exec_status", "match_status")
    joined = scored.join(outcome, "question_id", "left")
    gold_ok = F.coalesce("gold_exec_status", F.lit(False))
    pred_ok = F.coalesce("predict_exec_status", F.lit(False))
    return joined.groupBy(*by).agg(
        _percent(F.col("_exact")).alias("exact_match_accuracy"),
        _percent(F.coalesce("match_status", F.lit(False))).alias("execution_accuracy"),
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(~gold_ok).alias("gold_query_execution_failures"),
        F.count_if(~pred_ok).alias("predicted_query_execution_failures"),
        F.count_if(gold_ok & ~pred_ok).alias("predicted_failures_given_gold_ok"),
    )
