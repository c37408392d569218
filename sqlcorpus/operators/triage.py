"""Questions against earlier results: what succeeded, failed, or is still to do; and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sqlcorpus import schemas as S
from sqlcorpus.functions.keys import shuffle_key
from sqlcorpus.operators.ranking import rank_by_key
from sqlcorpus.session import BROADCAST_ROWS


def is_success(status: str = "generation_status", match: str = "execution_match") -> Column:
    """Generated, and the result matched: a null match is no match."""
    return F.col(status).eqNullSafe(S.SUCCESS) & F.col(match).eqNullSafe(True)


def first_results(results: DataFrame, order_by: str | None = None) -> DataFrame:
    """One result a question: the first by ``order_by``, ties and the rest in a fixed order.

    That order puts successes first, then the smallest database, label and other fields, so tasks and
    partitions decide nothing.
    """
    others = [name for name in results.columns if name != "question_id"]
    order = ([F.col(order_by)] if order_by else []) + fixed_order(results)
    first = results.groupBy("question_id").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return first.select("question_id", *[F.col(f"_first.{name}").alias(name) for name in others])


def fixed_order(results: DataFrame) -> list[Column]:
    """What orders several results of a question: success, then the fields of a decision, then all others."""
    have = results.columns
    success = [(~is_success()).alias("_failed")] if {"generation_status", "execution_match"} <= set(have) else []
    lead = [name for name in ("db_id", "level") if name in have]
    rest = [name for name in have if name not in ("question_id", *lead)]
    # Maps have no order; their text has.
    kinds = {field.name: field.dataType for field in results.schema.fields}
    plain = [F.col(n).cast("string").alias(n) if isinstance(kinds[n], T.MapType) else F.col(n) for n in [*lead, *rest]]
    return [*success, *plain]


def usable_results(results: DataFrame) -> DataFrame:
    """Results that could be read; corrupt entries count as absent."""
    if "_corrupt_record" in results.columns:
        results = results.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return results.filter(F.col("question_id").isNotNull())


def cache_state(success: Column) -> Column:
    """State of a question from the success of its result, null where there is no result."""
    return (
        F.when(success.isNull(), S.CACHE_CANDIDATE)
        .when(success, S.CACHE_SUCCESS)
        .otherwise(S.CACHE_FAILED)
    )


def triage(questions: DataFrame, results: DataFrame) -> DataFrame:
    """``question_id, db_id, level, cache_state`` of every question.

    A stored result speaks for its question, with the database and label it was stored with. Only
    the few columns a decision needs take part in the join.
    """
    found = usable_results(results)
    kept = [name for name in ("db_id", "level") if name in found.columns]
    # The least of these is the record that ``first_results`` keeps.
    first = F.min(F.struct((~is_success()).alias("_failed"), *kept)).alias("_first")
    stored = found.groupBy("question_id").agg(first).select(
        "question_id", (~F.col("_first._failed")).alias("_success"),
        *[F.col(f"_first.{name}").alias(f"_{name}") for name in kept],
    )
    joined = questions.select("question_id", "db_id", "level").join(stored, "question_id", "left")

    def told(name: str) -> Column:
        return F.coalesce(f"_{name}", name).alias(name) if name in kept else F.col(name)

    return joined.select(
        "question_id", told("db_id"), told("level"), cache_state(F.col("_success")).alias("cache_state")
    )


def merge_result(questions: DataFrame, results: DataFrame, how: str = "left") -> DataFrame:
    """Questions with their results, in the stored fields only; a result's value wins.

    Of several results ``first_results`` keeps one. With ``how="inner"`` only questions with a result stay.
    """
    found = first_results(usable_results(results))
    renamed = found.select("question_id", *[
        F.col(name).alias(f"_{name}") for name in found.columns if name != "question_id"
    ])
    joined = questions.join(renamed, "question_id", how)

    def merged(name: str) -> Column:
        sides = [F.col(side) for side in (f"_{name}", name) if side in joined.columns]
        kind = S.RESULTS[name].dataType
        value = F.coalesce(*sides) if sides else F.lit(None)
        return value.cast(kind).alias(name)

    return joined.select("question_id", *[merged(name) for name in S.RESULT_FIELDS[1:]])


def remaining(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions that have no answer yet."""
    ids = done.select(F.col("question_id").cast("string").alias("question_id"))
    return questions.join(ids, "question_id", "left_anti")


def split_domains(df: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """``db_id, domain``: every database in one domain, the first ``ratio`` of a shuffle in-domain."""
    databases = df.select("db_id").distinct().withColumn("_key", shuffle_key(F.col("db_id"), seed))
    ranked = rank_by_key(databases, "_key", ties=["db_id"], total="_databases")
    inside = F.col("rank") <= F.floor(F.col("_databases") * F.lit(float(ratio)))
    return ranked.select("db_id", F.when(inside, S.IN_DOMAIN).otherwise(S.OUT_OF_DOMAIN).alias("domain"))


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_domain(df: DataFrame, databases: DataFrame) -> DataFrame:
    """Rows of the given databases."""
    return df.join(databases.select("db_id"), "db_id", "left_semi")


def split_statistics(triaged: DataFrame, domains: DataFrame) -> DataFrame:
    """Questions by domain and cache state, counted by database before domains are looked up."""
    by_db = triaged.groupBy("db_id", "cache_state").agg(F.count(F.lit(1)).alias("_n"))
    joined = by_db.join(domains, "db_id")
    return joined.groupBy("domain", "cache_state").agg(F.sum("_n").alias("n"))
