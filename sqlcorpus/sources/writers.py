"""Writers. Appending is safe to repeat: what is stored already is left out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.text import format_prediction
from sqlcorpus.operators.triage import first_results
from sqlcorpus.session import path_exists
from sqlcorpus.sources.manifest import Manifest


def materialize_if_absent(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> DataFrame:
    """The table at ``path``, built and written only if there is none."""
    if not path_exists(spark, path):
        build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def new_rows(df: DataFrame, stored: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows whose key is not stored yet.

    The stored keys are first cut down to those at hand, so a large table is scanned in one column
    and filtered in place when the new rows are few, instead of being shuffled whole.
    """
    known = stored.select(key).join(df.select(key), key, "left_semi")
    return df.join(known, key, "left_anti")


def append_results(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """Store results by question in the fixed fields; the first one stored stays.

    Results that were not generated are left out, so their questions stay candidates. Jobs may append at once: rows go
    to a folder of their own, which counts from the version of the table's manifest that names it. A job that finds
    its version taken leaves out what the others have stored meanwhile and tries the next one.
    """
    spark = df.sparkSession
    missing = [name for name in S.RESULT_FIELDS if name not in df.columns]
    generated = df.filter(F.col("generation_status") == S.SUCCESS)
    full = generated.withColumns({name: F.lit(None) for name in missing})
    first = first_results(full, order_by).select(*[
        F.col(field.name).cast(field.dataType).alias(field.name) for field in S.RESULTS.fields
    ])
    manifest = Manifest(spark, path)
    version, folders = manifest.latest()
    rows = new_rows(first, manifest.read(S.RESULTS, folders)) if folders else first
    while True:
        own = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{own}")
        if manifest.commit(version + 1, [*folders, own]):
            return
        seen = set(folders)
        version, folders = manifest.latest()
        others = manifest.read(S.RESULTS, [name for name in folders if name not in seen])
        rows = new_rows(manifest.read(S.RESULTS, [own]), others)


def write_curated(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Curated rows, a folder a split."""
    df.write.mode(mode).partitionBy("split").format(fmt).save(path)


def write_baked(df: DataFrame, path: str) -> None:
    """Training rows, a folder a split; both validation splits together are a filter on it."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def format_predictions(df: DataFrame) -> DataFrame:
    """``question_id, value`` in submission format."""
    return df.select(
        F.col("question_id").cast("string").alias("question_id"),
        format_prediction(F.col("sql"), F.col("db_id")).alias("value"),
    )


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as text: one submission object of a single question a line."""
    format_predictions(df).select(F.to_json(F.create_map("question_id", "value")).alias("value")).write.mode("overwrite").text(path)


def write_submission(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Predictions as one JSON object of all questions, an entry a line, in the order of their ids.

    Tasks write ranges of ids into files whose names follow that order; the first of all lines opens the object and
    the last one closes it, so the files behind each other, as a folder is read, are the object. ``parts=1`` makes one
    file of it, written by one task that holds no more than a sort buffer; else Spark chooses how many there are.
    Question ids are keys.
    """
    json = F.to_json(F.create_map("question_id", "value"))
    inner = F.substr(json, F.lit(2), F.length(json) - 2)
    entries = format_predictions(df)
    first, last = entries.agg(F.min("question_id"), F.max("question_id")).first()
    if first is None:
        df.sparkSession.createDataFrame([("{",), ("}",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    line = F.concat(
        F.when(F.col("question_id") == F.lit(first), "{\n").otherwise(""), F.lit("  "), inner,
        F.when(F.col("question_id") == F.lit(last), "\n}").otherwise(","))
    lines = entries.select("question_id", line.alias("value"))
    dealt = lines.repartitionByRange("question_id") if parts is None else lines.repartitionByRange(parts, "question_id")
    dealt.sortWithinPartitions("question_id").select("value").write.mode("overwrite").text(path)


def append_raw(df: DataFrame, path: str) -> None:
    """Raw model output as JSON lines."""
    df.select(F.col("question_id").cast("string"), "raw_content").write.mode("append").json(path)
