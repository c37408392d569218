"""The prediction job: prompts for unanswered questions, model output, statements, and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.text import extract_sql
from sqlcorpus.operators.answers import AnswerLog
from sqlcorpus.operators.compare import compare_results
from sqlcorpus.operators.evaluate import evaluate
from sqlcorpus.operators.generate import Generator, generate
from sqlcorpus.operators.prompts import render_prompts
from sqlcorpus.operators.triage import remaining
from sqlcorpus.sources.readers import read_generations
from sqlcorpus.sources.writers import append_raw


def predict(
    questions: DataFrame,
    contexts: DataFrame,
    template: str,
    make: Callable[[], Generator],
    raw_path: str,
    instructions: str = "",
    batch_size: int = 16,
    attempts: int = S.RETRY_ATTEMPTS,
    delay: float = S.RETRY_BASE_DELAY_SEC,
    tasks: int | None = None,
    log: AnswerLog | None = None,
) -> DataFrame:
    """Answer the questions that have no stored output yet, and return all predictions.

    Output is stored when all tasks are done, with ``log`` also batch by batch while they run, so that a job or task
    that is lost asks nothing twice. A question whose batch failed is asked again by the next run.
    """
    spark = questions.sparkSession
    todo = remaining(questions, read_generations(spark, raw_path))
    prompts = render_prompts(todo, contexts, template, instructions=instructions)
    ask = generate if log is None else log.generate
    answers = ask(prompts, make, batch_size, attempts, delay, tasks)
    append_raw(answers.filter(F.col("raw_content").isNotNull()), raw_path)
    return to_predictions(questions, read_generations(spark, raw_path))


def to_predictions(questions: DataFrame, generations: DataFrame) -> DataFrame:
    """``question_id, sql, db_id`` of answered questions; of several answers the smallest text counts."""
    first = generations.groupBy("question_id").agg(F.min("raw_content").alias("raw_content"))
    answered = questions.select("question_id", "db_id").join(first, "question_id")
    return answered.select("question_id", extract_sql(F.col("raw_content")).alias("sql"), "db_id")


def score(
    predictions: DataFrame, references: DataFrame, rows: DataFrame, executions: DataFrame, by: list[str] = ()
) -> DataFrame:
    """Metrics of predictions, from the results of gold and predicted statements by question."""
    compared = compare_results(rows, executions).withColumnRenamed("pair_id", "question_id")
    joined = predictions.select("question_id", F.col("sql").alias("predicted_sql")).join(references, "question_id")
    return evaluate(joined, compared, by)
