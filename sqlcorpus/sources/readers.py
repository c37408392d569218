"""Readers. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sqlcorpus import schemas as S
from sqlcorpus.functions.text import parse_prediction
from sqlcorpus.session import first_characters, path_exists, qualified
from sqlcorpus.sources.manifest import Manifest

CORRUPT = "_corrupt_record"
# Names some columns carry in files.
FILE_NAMES = {"gold_sql": "SQL"}


def _require(spark: SparkSession, path: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_file_position(df: DataFrame, fmt: str, position: str = "position") -> DataFrame:
    """Add the 0-based place of each row over all files, taken in order of their names.

    Parquet knows a row's place in its file. Of other files each task numbers the rows of the splits it
    reads, in order, so a split's rows run on from its first number. Only rows a split are counted:
    nothing is sorted, and the rows themselves are not shuffled for it.
    """
    located = df.withColumn("_file", F.col("_metadata.file_path"))
    if fmt == "parquet":
        located = located.withColumns({"_split": F.lit(0).cast("bigint"), "_row": F.col("_metadata.row_index")})
        first = F.lit(0).cast("bigint")
    else:
        located = located.withColumns({
            "_split": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
        first = F.min("_row")
    # One row a split, as the driver lists them.
    sizes = located.groupBy("_file", "_split").agg(first.alias("_first"), (F.max("_row") + 1).alias("_end"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_file", "_split", "_first",
        F.coalesce(F.sum(F.col("_end") - F.col("_first")).over(before), F.lit(0)).alias("_start"))
    placed = located.join(starts, ["_file", "_split"])
    return placed.withColumn(position, F.col("_start") + F.col("_row") - F.col("_first")).drop(
        "_file", "_split", "_row", "_first", "_start")


def _named(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns under the library's names, whatever they are called in the file."""
    for ours, theirs in FILE_NAMES.items():
        if ours in schema.names and theirs in df.columns:
            df = df.drop(ours) if ours in df.columns else df
            df = df.withColumnRenamed(theirs, ours)
    return df


def _file_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField(FILE_NAMES.get(field.name, field.name), field.dataType) for field in schema.fields]
    )


def _read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    marked = T.StructType([*_file_schema(schema).fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(marked).option("columnNameOfCorruptRecord", CORRUPT)
    return _named(reader.option("multiLine", multi_line).json(path), schema)


def _as_text(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, cast to its types, nulls for those a file lacks."""
    have = set(df.columns)
    return df.select(*[
        (F.col(field.name) if field.name in have else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in schema.fields
    ], *[name for name in (CORRUPT, "position") if name in have])


def read_questions(
    spark: SparkSession, path: str, fmt: str = "json", with_position: bool = False
) -> DataFrame:
    """A corpus of questions: a JSON array, JSON lines (``jsonl``) or Parquet.

    A missing path or a file that is no JSON array of objects is an error; broken JSON is found, and
    ends the job, when it is read.
    """
    _require(spark, path)
    if fmt == "parquet":
        raw = _named(spark.read.parquet(path), S.QUESTIONS)
        if with_position:
            raw = with_file_position(raw, fmt)
        return _as_text(raw, S.QUESTIONS)
    if fmt == "json":
        wrong = [name for name, first in first_characters(spark, path) if first not in ("[", "")]
        if wrong:
            raise ValueError(f"{wrong[0]} is not a JSON array of records")
    # A record that cannot be read ends the job.
    reader = spark.read.schema(_file_schema(S.QUESTIONS)).option("mode", "FAILFAST")
    raw = _named(reader.option("multiLine", fmt == "json").json(path), S.QUESTIONS)
    if with_position:
        raw = with_file_position(raw, fmt)
    return _as_text(raw, S.QUESTIONS)


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Schema catalogs, one row a database; the last entry of a database counts."""
    from sqlcorpus.operators.catalog import latest_catalog

    _require(spark, path)
    reader = spark.read.schema(S.CATALOG)
    raw = reader.parquet(path) if fmt == "parquet" else reader.option("multiLine", True).json(path)
    return latest_catalog(with_file_position(raw, fmt))


def discover_databases(spark: SparkSession, root: str) -> DataFrame:
    """``db_id, table_name, path`` of the Parquet tables below ``<root>/<db_id>/<table>``.

    A table is a file or a folder of files. Only the folder listing is read.
    """
    _require(spark, root)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(root).select("path")
    )
    # The root is cut from the front, as its name may come again below it.
    parts = F.split(F.substring("path", len(qualified(spark, root)) + 2, 1 << 20), "/")
    table = F.regexp_replace(F.get(parts, F.lit(1)), r"\.parquet$", "")
    base = F.concat(F.lit(root.rstrip("/")), F.lit("/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)))
    found = files.filter(F.size(parts) >= 2).select(
        F.get(parts, F.lit(0)).alias("db_id"), table.alias("table_name"), base.alias("path")
    ).distinct()
    if not found.take(1):
        raise FileNotFoundError(f"no tables below {root}")
    return found


def _loose_boolean(name: str) -> Column:
    """True and false as such; any other word, such as ``Failure``, is false."""
    text = F.lower(F.col(name))
    return F.when(text.isNotNull(), text == "true").alias(name)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored results; JSON entries that cannot be read keep their text in ``_corrupt_record``."""
    if fmt == "parquet":
        manifest = Manifest(spark, path)
        return manifest.read(S.RESULTS, manifest.latest()[1])
    _require(spark, path)
    words = T.StructType([T.StructField(field.name, T.StringType()) for field in S.RESULTS.fields])
    raw = _read_json(spark, path, words, fmt == "json")
    booleans = [f.name for f in S.RESULTS.fields if isinstance(f.dataType, T.BooleanType)]
    return raw.select(*[
        _loose_boolean(name) if name in booleans else F.col(name) for name in raw.columns
    ])


def read_curated(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of curated splits that were generated; nothing if there is no such table yet."""
    if not path_exists(spark, path):
        return _empty(spark, S.CURATED)
    df = spark.read.schema(S.CURATED).parquet(path).filter(F.col("generation_status") == S.SUCCESS)
    return df if split is None else df.filter(F.col("split") == split)


def read_splits(
    spark: SparkSession, folder: str, mapping: dict[str, str] = S.PUBLISHED_SPLITS,
    schema: T.StructType = S.RESULTS, fmt: str = "json",
) -> DataFrame:
    """Files ``<name>.json`` (or ``.parquet``) as one table with a ``split`` column, names mapped."""
    parts = []
    for name, split in mapping.items():
        path = f"{folder}/{name}.{'parquet' if fmt == 'parquet' else 'json'}"
        _require(spark, path)
        if fmt == "parquet":
            part = spark.read.parquet(path)
        else:
            part = _read_json(spark, path, schema, fmt == "json").drop(CORRUPT)
        parts.append(_named(part, schema).drop("split").withColumn("split", F.lit(split)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def resolve_source(spark: SparkSession, explicit: str | None, folder: str, default: str) -> tuple[str, dict[str, str]]:
    """Where to read splits from, and their file names: the explicit place, else complete files in
    ``folder``, else the default place."""
    if explicit:
        return explicit, S.PUBLISHED_SPLITS
    own = {split: split for split in S.SPLITS}
    if all(path_exists(spark, f"{folder}/{name}.json") for name in own):
        return folder, own
    return default, S.PUBLISHED_SPLITS


def load_template(spark: SparkSession, path: str) -> str:
    """The text of a prompt template."""
    _require(spark, path)
    return spark.read.text(path, wholetext=True).first()[0]


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """Raw model output as JSON lines; nothing if there is none yet."""
    if not path_exists(spark, path):
        return _empty(spark, S.GENERATIONS)
    return spark.read.schema(S.GENERATIONS).json(path)


def parse_predictions(df: DataFrame) -> DataFrame:
    """``question_id, sql, db_id`` from submission objects in a ``value`` text column."""
    entries = df.select(F.explode(F.from_json("value", "map<string,string>")).alias("question_id", "_value"))
    parsed = entries.select("question_id", parse_prediction(F.col("_value")).alias("_parts"))
    return parsed.select("question_id", "_parts.sql", "_parts.db_id")


def read_predictions(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Predictions as written by ``write_predictions``; ``whole`` reads one object a file."""
    if not path_exists(spark, path):
        return _empty(spark, S.PREDICTIONS)
    return parse_predictions(spark.read.text(path, wholetext=whole))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as ``write_submission`` stores them, line by line, so that any number of tasks read one object."""
    if not path_exists(spark, path):
        return _empty(spark, S.PREDICTIONS)
    line = F.rtrim(F.col("value"))
    entry = F.concat(F.lit("{"), F.regexp_replace(line, ",$", ""), F.lit("}"))
    return parse_predictions(spark.read.text(path).filter(~line.isin("{", "}")).select(entry.alias("value")))
