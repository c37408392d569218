"""Model output by a user's function, with retries, and its verification."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.text import FENCE, extract_with_reasoning
from sqlcorpus.operators.compare import compare_results
from sqlcorpus.operators.triage import merge_result

Generator = Callable[[Sequence[str]], Sequence[str]]

GENERATED = "question_id string, raw_content string, generation_status string, error_message string"


class ContextLengthExceeded(Exception):
    """The model refuses the prompt for its length; asking again is no use."""


def with_retry(
    fn: Generator,
    attempts: int = S.RETRY_ATTEMPTS,
    base: float = S.RETRY_BASE_DELAY_SEC,
    sleep: Callable[[float], None] = time.sleep,
) -> Generator:
    """Call again after a failure, waiting ``base * 2**attempt`` seconds before each further attempt."""

    def call(prompts: Sequence[str]) -> Sequence[str]:
        for attempt in range(attempts):
            if attempt:
                sleep(base * 2**attempt)
            try:
                return fn(prompts)
            except ContextLengthExceeded:
                raise
            except Exception:
                if attempt == attempts - 1:
                    raise
        raise RuntimeError("no attempt was made")

    return call


def generate(
    df: DataFrame,
    make: Callable[[], Generator],
    batch_size: int = 16,
    attempts: int = S.RETRY_ATTEMPTS,
    delay: float = S.RETRY_BASE_DELAY_SEC,
    tasks: int | None = None,
    needs_sql: bool = False,
) -> DataFrame:
    """Send prompts to a model in batches and return its raw output by question.

    ``df`` has ``question_id, prompt``. ``make`` builds the model's function, once a partition; with
    ``tasks`` the prompts are dealt out to that many. A batch that fails is sent again, up to
    ``attempts`` times in all, and then yields error rows; the others go on. With ``needs_sql`` a prompt
    whose answer holds no closed block is asked again likewise. A prompt refused for its length is
    not; prompts that are null exceed the budget and are not sent.

    The model may be slow or paid for: store the result before two operators read it, or ask through
    ``answers.AnswerLog``, which keeps each answer as it comes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = with_retry(make(), attempts, delay)
        for frame in frames:
            ids, prompts = frame["question_id"].tolist(), frame["prompt"].tolist()
            found: list[tuple] = []
            for start in range(0, len(ids), batch_size):
                batch = slice(start, start + batch_size)
                found += ask_batch(fn, ids[batch], prompts[batch], attempts, needs_sql)
            yield pd.DataFrame(
                found, columns=["question_id", "raw_content", "generation_status", "error_message"], dtype=object)

    sent = df.select(F.col("question_id").cast("string").alias("question_id"), "prompt")
    return (sent if tasks is None else sent.repartition(tasks)).mapInPandas(run, GENERATED)


def ask_batch(
    fn: Generator, ids: list[str], prompts: list[str | None], attempts: int, needs_sql: bool
) -> list[tuple]:
    """(id, answer, status, error) of one batch; with ``needs_sql`` answers without a closed block are asked again."""
    rows = _one_batch(fn, ids, prompts)
    for _ in range(attempts - 1 if needs_sql else 0):
        again = [i for i, row in enumerate(rows) if row[2] == S.SUCCESS and not _has_block(row[1])]
        if not again:
            break
        for i, row in zip(again, _one_batch(fn, [ids[i] for i in again], [prompts[i] for i in again])):
            rows[i] = row
    return rows


def _has_block(answer: str | None) -> bool:
    """Whether ``extract_with_reasoning`` finds a statement."""
    return (answer or "").count(FENCE) >= 2


def _one_batch(fn: Generator, ids: list[str], prompts: list[str | None]) -> list[tuple]:
    answers: list[str | None] = [None] * len(ids)
    errors: list[str | None] = [S.CONTEXT_EXCEEDED] * len(ids)
    sent = [i for i, prompt in enumerate(prompts) if prompt is not None]
    if sent:
        try:
            found = list(fn([prompts[i] for i in sent]))
            if len(found) != len(sent):
                raise ValueError(f"{len(found)} answers to {len(sent)} prompts")
            for i, answer in zip(sent, found):
                answers[i], errors[i] = answer, None
        except ContextLengthExceeded:
            pass
        except Exception as error:
            for i in sent:
                errors[i] = str(error)
    status = [S.SUCCESS if error is None else S.ERROR for error in errors]
    return list(zip(ids, answers, status, errors))


def extract_responses(generated: DataFrame) -> DataFrame:
    """Generated text split into statement and reasoning; no statement is an error.

    Output: ``question_id, predicted_sql, final_reasoning, generation_status, raw_output, error_message``.
    """
    parts = generated.withColumn("_parts", extract_with_reasoning(F.col("raw_content")))
    answered = F.col("generation_status") == S.SUCCESS
    found = answered & (F.col("_parts.status") == S.SUCCESS)
    return parts.select(
        "question_id",
        F.when(found, F.col("_parts.sql")).alias("predicted_sql"),
        F.col("_parts.reasoning").alias("final_reasoning"),
        F.when(found, S.SUCCESS).otherwise(S.ERROR).alias("generation_status"),
        F.col("raw_content").alias("raw_output"),
        F.when(answered & ~found, F.concat(F.lit("Generation failed: "), F.col("_parts.sql")))
        .otherwise(F.col("error_message"))
        .alias("error_message"),
    )


def verify_candidates(
    candidates: DataFrame, generated: DataFrame, rows: DataFrame, executions: DataFrame
) -> DataFrame:
    """One stored-result row for every candidate that has generated text.

    ``rows`` and ``executions`` hold the results of gold and predicted statements, the pair being
    the question, as ``compare_results`` takes them.
    """
    parts = extract_responses(generated)
    compared = compare_results(rows, executions).select(
        F.col("pair_id").alias("question_id"),
        F.col("match_status").alias("_match"),
        F.col("predict_exec_status").alias("_ran"),
        F.col("error_msg").alias("error_occurred"),
    )
    joined = parts.join(compared, "question_id", "left")
    generated_ok = F.col("generation_status") == S.SUCCESS
    scored = joined.select(
        *parts.columns,
        F.when(generated_ok, F.coalesce("_match", F.lit(False))).alias("execution_match"),
        F.when(generated_ok, F.coalesce("_ran", F.lit(False))).alias("predicted_exec_status"),
        F.when(generated_ok, F.col("error_occurred")).alias("error_occurred"),
    )
    return merge_result(candidates, scored, "inner")
