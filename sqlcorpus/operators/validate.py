"""Question ids, validation of a corpus and its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.operators.ranking import rank_by_order

REQUIRED = ["question_id", "db_id", "gold_sql", "level"]
FAILED_CHECKS = ["missing_question_id", "missing_db_id", "missing_sql", "missing_level"]


def assign_question_id(df: DataFrame, order_by: str | None = None, position: str = "position") -> DataFrame:
    """Give questions without an id their 0-based place in the corpus, as text.

    The place is a column the reader added (``position``), or the rank by ``order_by``.
    """
    if order_by is not None:
        df = rank_by_order(df, order_by, "_rank").withColumn("_place", F.col("_rank") - 1).drop("_rank")
    else:
        df = df.withColumnRenamed(position, "_place")
    filled = F.coalesce(F.col("question_id").cast("string"), F.col("_place").cast("string"))
    return df.withColumn("question_id", filled).drop("_place")


def is_valid() -> Column:
    """Whether a question has its id, its database and a label. A null statement is labelled, so it passes."""
    level = F.coalesce(F.col("level"), F.lit(""))
    return F.col("question_id").isNotNull() & F.col("db_id").isNotNull() & (level != "")


def validate_questions(df: DataFrame) -> DataFrame:
    """The questions that can be curated."""
    return df.filter(is_valid())


def validation_report(df: DataFrame) -> DataFrame:
    """One row: questions, valid questions, and how many lack each required value."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_valid()).alias("valid"),
        F.count_if(F.col("question_id").isNull()).alias("missing_question_id"),
        F.count_if(F.col("db_id").isNull()).alias("missing_db_id"),
        F.count_if(F.col("gold_sql").isNull()).alias("missing_sql"),
        F.count_if(F.coalesce(F.col("level"), F.lit("")) == "").alias("missing_level"),
    )
