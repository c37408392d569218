"""The labelling job: a raw corpus to questions with ids and complexity labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus.functions.labels import classify_sql
from sqlcorpus.operators.validate import assign_question_id
from sqlcorpus.sources.readers import read_questions
from sqlcorpus.sources.writers import materialize_if_absent


def label_questions(questions: DataFrame, word_bounded: bool = False) -> DataFrame:
    """Questions with the label of their statement."""
    return questions.withColumn("level", classify_sql(F.col("gold_sql"), word_bounded))


def label_corpus(spark: SparkSession, source: str, target: str, fmt: str = "json") -> DataFrame:
    """The labelled corpus at ``target``, made from ``source`` if it is not there yet."""

    def build() -> DataFrame:
        raw = read_questions(spark, source, fmt, with_position=True)
        return label_questions(assign_question_id(raw))

    return materialize_if_absent(spark, build, target)
