"""Incremental ingest of raw model output, and running label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sqlcorpus import schemas as S
from sqlcorpus.functions.labels import classify_sql
from sqlcorpus.functions.text import extract_sql
from sqlcorpus.session import folder_names
from sqlcorpus.sources.writers import new_rows

INGESTED = "question_id string, raw_content string, sql string"
#: Folders into which a target is divided by a hash of the question; fixed for the life of a target.
BUCKETS = 256


def question_bucket() -> Column:
    return F.pmod(F.xxhash64("question_id"), F.lit(BUCKETS)).cast("int")


def stored_in(spark: SparkSession, target: str, buckets: list[int]) -> DataFrame | None:
    """Stored rows of some buckets, none if there are none; no other folder is listed or read."""
    there = folder_names(spark, target)
    folders = [f"{target}/bucket={b}" for b in buckets if f"bucket={b}" in there]
    if not folders:
        return None
    return spark.read.schema(f"{INGESTED}, bucket int, batch_id bigint").option("basePath", target).parquet(*folders)


def ingest_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    """Store the questions of a batch that no other batch has stored.

    A target is laid out by buckets of questions, and a batch reads the ids of the buckets that its own questions
    fall into. In each of them it owns one folder and writes it whole, so repeating a batch, also one that was
    interrupted while writing, changes nothing.
    """
    spark = batch.sparkSession
    first = batch.groupBy("question_id").agg(F.min("raw_content").alias("raw_content")).withColumn(
        "bucket", question_bucket())
    touched = sorted(row["bucket"] for row in first.select("bucket").distinct().collect())  # at most BUCKETS numbers
    stored = stored_in(spark, target, touched)
    if stored is not None:
        first = new_rows(first, stored.filter(F.col("batch_id") != batch_id))
    rows = first.select("question_id", "raw_content", extract_sql(F.col("raw_content")).alias("sql"), "bucket",
                        F.lit(batch_id).alias("batch_id"))
    # Rows of a bucket meet in one task, which writes one file; only folders of this batch are replaced.
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket", "batch_id").parquet(target)


def stream_ingest(
    spark: SparkSession, source: DataFrame | str, target: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Ingest a stream of ``question_id, raw_content``, keeping one text of each question: that of its first batch,
    the smallest one in it.

    ``source`` is a streaming table or a folder of JSON lines. Questions may return at any time, so
    what counts is the target table, and the stream itself keeps no state.
    """
    if isinstance(source, str):
        source = spark.readStream.schema(S.GENERATIONS).json(source)
    writer = source.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, target))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{INGESTED}, bucket int, batch_id bigint").parquet(target).drop("bucket", "batch_id")


def stream_level_counts(questions: DataFrame) -> DataFrame:
    """Running rows by label of a stream of questions; the state is one number a label."""
    return questions.groupBy(classify_sql(F.col("gold_sql")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
