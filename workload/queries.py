"""The registered queries: each runs operators of the library over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions import labels, tables, text
from sqlcorpus.operators import catalog as C, compare, evaluate as E, fill, prompts, quota, reports, triage, validate
from sqlcorpus.operators.answers import AnswerLog
from sqlcorpus.operators.generate import extract_responses, generate, verify_candidates
from sqlcorpus.plans.bake import prompt_contexts
from sqlcorpus.plans.curate import Settings, curate, curate_in_domain, curate_single, fetch_curated
from sqlcorpus.plans.pools import Domain, prepare_domains
from sqlcorpus.plans.waves import AskedPool
from sqlcorpus.session import Workspace
from sqlcorpus.sources import readers, writers
from sqlcorpus.sources.readers import parse_predictions, with_file_position
from sqlcorpus.sources.writers import format_predictions, new_rows
from sqlcorpus.streaming.ingest import read_ingested, stream_ingest, stream_level_counts
from workload import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]

TEMPLATE = (Path(__file__).parent / "template.txt").read_text(encoding="utf-8")

# Small quotas, so that some databases stay uncovered.
SMALL = Settings(train_size=40, val_in_size=8, val_out_size=40)
LEVELS = [S.LEVEL_4, S.LEVEL_3, S.LEVEL_2, S.LEVEL_1]


def even(size: int) -> dict[str, int]:
    """A size that four labels share evenly."""
    return {**{level: size // 4 for level in LEVELS}, S.LEVEL_OTHER: 0}


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return X.of(spark, sf, X.QUESTIONS)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).withColumn("level", labels.classify_sql(F.col("gold_sql")))


def results(spark: SparkSession, sf: str) -> DataFrame:
    return X.of(spark, sf, X.RESULTS)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return X.of(spark, sf, X.RESPONSES)


def triaged(spark: SparkSession, sf: str) -> DataFrame:
    return triage.triage(labelled(spark, sf), results(spark, sf))


def pool(spark: SparkSession, sf: str, state: str) -> DataFrame:
    """Stored questions of one state, as every fill reads its pool twice."""
    kept = triaged(spark, sf).filter(F.col("cache_state") == state)
    return Workspace(spark).table(kept, f"pool_{state}")


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return triage.split_domains(questions(spark, sf))


def existing(spark: SparkSession, sf: str) -> DataFrame:
    """Rows an earlier run put into splits."""
    number = F.col("question_id").cast("bigint") % 97
    split = F.when(number == 1, S.TRAIN).when(number == 2, S.VAL_IN).when(number == 3, S.VAL_OUT)
    return labelled(spark, sf).select("question_id", "db_id", "level", split.alias("split")).filter("split is not null")


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """All questions, each in a split."""
    number = F.col("question_id").cast("bigint") % 3
    split = F.when(number == 0, S.TRAIN).when(number == 1, S.VAL_IN).otherwise(S.VAL_OUT)
    return labelled(spark, sf).select("question_id", "db_id", "level", split.alias("split"))


def of_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog, stored as its reader leaves it: the last entry of each database.

    Entries are long and customers short, so customers are dealt out before entries are made of them.
    """
    customers = X.table(spark, sf, "customer").repartition("c_custkey")
    entries = spark.sql(X.CATALOG, customer=customers).withColumn("position", F.lit(0))
    return Workspace(spark).table(C.latest_catalog(entries), "catalog")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    first = C.sample_tables(X.of(spark, sf, X.SAMPLE_SOURCE), 3, ["o_orderkey"])
    cells = C.sample_cells(first, ["o_orderkey", "note", "o_totalprice", "extra"])
    return first.select("db_id", "table_idx", "row_no", F.slice(cells, F.lit(1), F.col("width")).alias("cells"))


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    return prompt_contexts(catalog(spark, sf), samples(spark, sf))


def stored_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return Workspace(spark).table(contexts(spark, sf), "contexts")


def compared(spark: SparkSession, sf: str) -> DataFrame:
    raw = X.of(spark, sf, X.RESULT_ROWS)
    rows = compare.result_rows(raw, F.col("pair_id"), F.col("side"), ["c1", "c2"])
    runs = X.of(spark, sf, X.EXECUTIONS).withColumn("pair_id", F.col("pair_id").cast("string"))
    return compare.compare_results(rows, runs)


REGISTERED: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


# Labels, ids and validation.


@query
def sql_features(spark, sf):
    features = labels.sql_features(F.col("gold_sql"))
    return questions(spark, sf).select("question_id", features.alias("f")).select("question_id", "f.*")


@query
def classify_sql(spark, sf):
    return labelled(spark, sf).select("question_id", "level")


@query
def classify_sql_word_bounded(spark, sf):
    level = labels.classify_sql(F.col("gold_sql"), word_bounded=True)
    return questions(spark, sf).select("question_id", level.alias("level"))


@query
def level_distribution(spark, sf):
    return reports.level_distribution(labelled(spark, sf))


@query
def level_distribution_documents(spark, sf):
    """Whole documents labelled as if they were statements."""
    docs = X.table(spark, sf, "documents")
    return reports.level_distribution(docs.select(labels.classify_sql(F.col("text")).alias("level")))


def _without_some_ids(df: DataFrame) -> DataFrame:
    gap = F.col("o_orderkey") % 3 == 0
    return df.withColumn("question_id", F.when(~gap, F.concat(F.lit("q"), F.col("o_orderkey").cast("string"))))


@query
def assign_question_id(spark, sf):
    """Places by an order column."""
    orders = _without_some_ids(X.table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    return validate.assign_question_id(orders, order_by="o_orderkey")


@query
def assign_question_id_by_file(spark, sf):
    """Places by position in the files."""
    placed = with_file_position(X.table(spark, sf, "orders"), "parquet").select("o_orderkey", "position")
    return validate.assign_question_id(_without_some_ids(placed))


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("question_id").cast("bigint")
    return labelled(spark, sf).withColumns({
        "db_id": F.when(number % 11 != 0, F.col("db_id")),
        "level": F.when(number % 13 == 0, "").when(number % 17 != 0, F.col("level")),
    })


@query
def validate_questions(spark, sf):
    return validate.validate_questions(_gappy(spark, sf)).select("question_id", "db_id", "level")


@query
def validation_report(spark, sf):
    return validate.validation_report(_gappy(spark, sf))


# Triage and domains.


@query
def triage_questions(spark, sf):
    return triaged(spark, sf)


@query
def merge_result(spark, sf):
    merged = triage.merge_result(labelled(spark, sf), results(spark, sf))
    return merged.select("question_id", "db_id", "level", "predicted_sql", "generation_status", "execution_match")


@query
def first_result(spark, sf):
    """The first of many results of a question: line items by price."""
    items = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), "l_partkey", "l_extendedprice",
        F.struct("l_extendedprice", "l_partkey").alias("order"),
    )
    return triage.first_results(items, "order").select("question_id", "l_partkey", "l_extendedprice")


@query
def split_domains(spark, sf):
    return domains(spark, sf)


@query
def split_statistics(spark, sf):
    return triage.split_statistics(triaged(spark, sf), domains(spark, sf))


@query
def in_domain(spark, sf):
    chosen = domains(spark, sf).filter(F.col("domain") == S.OUT_OF_DOMAIN)
    return triage.in_domain(questions(spark, sf), chosen).select("question_id", "db_id")


@query
def remaining(spark, sf):
    done = results(spark, sf).filter(triage.is_success())
    return triage.remaining(questions(spark, sf), done).select("question_id", "db_id")


@query
def new_results(spark, sf):
    """Answers that an append would store beside what is stored."""
    return new_rows(responses(spark, sf), results(spark, sf)).select("question_id", "generation_status")


@query
def locked_ids(spark, sf):
    splits = placed(spark, sf)
    parts = [of_split(splits, split).select("question_id") for split in S.SPLITS]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query
def missing_databases(spark, sf):
    few = placed(spark, sf).filter((F.col("level") == S.LEVEL_2) & (F.col("split") == S.TRAIN))
    expected = questions(spark, sf).select("db_id").union(
        X.table(spark, sf, "nation").select(F.concat(F.lit("db_"), "n_name")))
    return reports.missing_databases(few, expected)


# Quotas and fills.


@query
def target_counts(spark, sf):
    """A quota for every customer, as large as their number of orders."""
    sizes = X.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    return quota.target_counts(sizes)


@query
def target_counts_strict(spark, sf):
    """A quota for every part, as large as its price in cents, by uneven shares."""
    sizes = X.table(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("size"))
    shares = {S.LEVEL_4: 0.35, S.LEVEL_3: 0.3, S.LEVEL_2: 0.2, S.LEVEL_1: 0.15, S.LEVEL_OTHER: 0.0}
    return quota.target_counts(sizes, shares=shares, strict_compat=True)


@query
def fill_single(spark, sf):
    return fill.fill_single(pool(spark, sf, S.CACHE_SUCCESS), even(1600), existing=of_split(existing(spark, sf), S.VAL_OUT))


@query
def fill_dual(spark, sf):
    held = existing(spark, sf)
    return fill.fill_dual(
        pool(spark, sf, S.CACHE_SUCCESS), even(6000), even(800), of_split(held, S.TRAIN), of_split(held, S.VAL_IN), held
    )


@query
def fill_dual_capped(spark, sf):
    """Splits resumed with rows of a label beyond its target, so that the total binds."""
    held = existing(spark, sf).filter(F.col("level") == S.LEVEL_OTHER)
    return fill.fill_dual(
        pool(spark, sf, S.CACHE_SUCCESS), even(400), even(100), of_split(held, S.TRAIN), of_split(held, S.VAL_IN), held
    )


@query
def pending(spark, sf):
    return quota.pending(quota.quota_frame(spark, {S.TRAIN: even(2000), S.VAL_IN: even(100)}), placed(spark, sf))


@query
def unfilled_levels(spark, sf):
    goals = quota.quota_frame(spark, {S.TRAIN: even(4000), S.VAL_IN: even(12)})
    return quota.unfilled_levels(quota.pending(goals, placed(spark, sf)))


@query
def target_vs_filled(spark, sf):
    return reports.target_vs_filled(
        placed(spark, sf), quota.quota_frame(spark, {S.TRAIN: even(2000), S.VAL_IN: even(100)})
    )


@query
def verify_fill_dual(spark, sf):
    held = existing(spark, sf)
    return fill.verify_fill_dual(
        pool(spark, sf, S.CACHE_CANDIDATE), responses(spark, sf), even(6000), even(800),
        of_split(held, S.TRAIN), of_split(held, S.VAL_IN), held,
    )


@query
def verify_fill_single(spark, sf):
    held = existing(spark, sf)
    return fill.verify_fill_single(
        pool(spark, sf, S.CACHE_CANDIDATE), responses(spark, sf), even(1600), S.VAL_OUT, of_split(held, S.VAL_OUT), held
    )


@query
def backfill_dual(spark, sf):
    return fill.backfill_dual(pool(spark, sf, S.CACHE_SUCCESS), 120, 700, existing(spark, sf))


@query
def backfill_single(spark, sf):
    return fill.backfill_single(pool(spark, sf, S.CACHE_SUCCESS), 300, existing(spark, sf))


@query
def cover_dual(spark, sf):
    held = existing(spark, sf).filter(F.col("level") == S.LEVEL_4)
    return fill.cover_dual(pool(spark, sf, S.CACHE_CANDIDATE), responses(spark, sf), held, 400, 390, 69, held)


@query
def cover_single(spark, sf):
    held = existing(spark, sf).filter(F.col("level") == S.LEVEL_2)
    return fill.cover_single(pool(spark, sf, S.CACHE_CANDIDATE), responses(spark, sf), held, 100, 95, held)


@query
def active_fill_dual(spark, sf):
    return fill.active_fill_dual(
        pool(spark, sf, S.CACHE_CANDIDATE), responses(spark, sf), 50, 250, existing(spark, sf)
    )


@query
def active_fill_single(spark, sf):
    return fill.active_fill_single(
        pool(spark, sf, S.CACHE_CANDIDATE), responses(spark, sf), 200, existing(spark, sf)
    )


def _domains(workspace: Workspace, spark: SparkSession, sf: str) -> dict[str, Domain]:
    return prepare_domains(workspace, labelled(spark, sf), results(spark, sf), responses(spark, sf), S.LEVELS)


def _curated(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    return curate(Workspace(spark), questions(spark, sf), results(spark, sf), responses(spark, sf), settings)


@query
def curate_in_domain_large(spark, sf):
    workspace = Workspace(spark)
    inside = _domains(workspace, spark, sf)[S.IN_DOMAIN]
    return curate_in_domain(
        workspace, inside.success, inside.passed, even(6000), even(800), inside.databases.count()
    )


@query
def curate_out_of_domain_large(spark, sf):
    workspace = Workspace(spark)
    outside = _domains(workspace, spark, sf)[S.OUT_OF_DOMAIN]
    return curate_single(workspace, outside.success, outside.passed, even(1600), outside.databases.count())


@query
def curate_small(spark, sf):
    return _curated(spark, sf, SMALL)


@query
def curate_small_asked(spark, sf):
    """``curate_small`` with a model that is asked while stages fill, instead of responses to all candidates."""
    workspace = Workspace(spark)
    known = workspace.table(responses(spark, sf), "responses")

    def verify(rows: DataFrame) -> DataFrame:
        return rows.join(known, "question_id")

    return curate(workspace, labelled(spark, sf), results(spark, sf), None, SMALL, verify=verify)


@query
def cover_customers_asked(spark, sf):
    """Coverage of databases, here a customer each, by a model that is asked for the candidates of thin ones only."""
    workspace = Workspace(spark)
    known = workspace.table(responses(spark, sf), "responses")
    owner = X.of(spark, sf, X.OWNERS)
    candidates = workspace.table(
        pool(spark, sf, S.CACHE_CANDIDATE).drop("db_id").join(owner, "question_id"), "candidates")
    held = workspace.table(existing(spark, sf).drop("db_id").join(owner, "question_id"), "held")
    databases = owner.select("db_id").distinct().count()
    asked = AskedPool(workspace, candidates, lambda rows: rows.join(known, "question_id"), held)
    asked.ask_databases(held, S.COVERAGE_DENSITY)
    return fill.cover_dual(asked.rows, None, held, 10 * databases, 0, databases, held)


@query
def curate_records(spark, sf):
    """The stored records of ``curate_small``, where answers to candidates also hold failed and repeated ones."""
    found = fetch_curated(
        _curated(spark, sf, SMALL), labelled(spark, sf), results(spark, sf), X.of(spark, sf, X.SEVERAL_RESPONSES))
    return found.select(*S.RESULT_FIELDS, "split", "stage")


# Sources and sinks: written to the shared folder and read again.


@query
def read_questions_json(spark, sf):
    """JSON lines of several files, numbered over all of them."""
    path = Workspace(spark).path("questions")
    asked = questions(spark, sf).withColumnRenamed("gold_sql", "SQL")
    asked.repartitionByRange(3, F.col("question_id").cast("bigint")).sortWithinPartitions(
        F.col("question_id").cast("bigint")).write.json(path)
    read = readers.read_questions(spark, path, "jsonl", with_position=True)
    return read.select("question_id", "db_id", "question", "evidence", "gold_sql", F.col("position").cast("bigint").alias("position"))


@query
def read_catalog_json(spark, sf):
    """JSON arrays of a hundred databases a file; an older entry precedes each."""
    path = Workspace(spark).path("catalog")
    entries = X.of(spark, sf, X.CATALOG)
    both = entries.withColumn("table_names", F.array(F.lit("a"))).unionByName(entries)
    chunk = F.floor(F.substring("db_id", 4, 20).cast("bigint") / 100).alias("chunk")
    lines = both.select(chunk, F.to_json(F.struct(*entries.columns)).alias("line")).groupBy("chunk").agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("line")), ","), F.lit("]")).alias("value"))
    lines.write.partitionBy("chunk").text(path)
    read = readers.read_catalog(spark, path)
    return read.select("db_id", F.size("column_names_original").cast("bigint").alias("n_columns"), F.array_join("table_names_original", ",").alias("tables"))


@query
def append_results(spark, sf):
    """Results stored, then answers appended: the first record of a question stays."""
    path = Workspace(spark).path("results")
    stored = triage.usable_results(results(spark, sf))
    writers.append_results(stored, path)
    writers.append_results(X.of(spark, sf, X.SEVERAL_RESPONSES), path)
    return readers.read_results(spark, path).select("question_id", "predicted_sql", "execution_match", "final_reasoning")


@query
def write_curated(spark, sf):
    path = Workspace(spark).path("curated")
    merged = triage.merge_result(labelled(spark, sf), results(spark, sf))
    rows = merged.join(placed(spark, sf).select("question_id", "split"), "question_id")
    writers.write_curated(rows, path)
    return readers.read_curated(spark, path).select("question_id", "level", "predicted_sql", "execution_match", "split")


@query
def read_splits(spark, sf):
    folder = Workspace(spark).path("splits")
    for split in S.SPLITS:
        of_split(placed(spark, sf), split).drop("split").write.parquet(f"{folder}/{split}.parquet")
    read = readers.read_splits(spark, folder, {split: split for split in S.SPLITS}, fmt="parquet")
    return read.select("question_id", "db_id", "level", "split")


@query
def read_splits_resolved(spark, sf):
    """Splits from wherever they are: an own folder that is complete, else the place of a published copy."""
    workspace = Workspace(spark)
    own, published = workspace.path("own"), workspace.path("published")
    rows = placed(spark, sf)
    for name, split in S.PUBLISHED_SPLITS.items():
        of_split(rows, split).drop("split").write.json(f"{published}/{name}.json")
    of_split(rows, S.TRAIN).drop("split").write.json(f"{own}/{S.TRAIN}.json")
    folder, names = readers.resolve_source(spark, None, own, published)
    return readers.read_splits(spark, folder, names, fmt="jsonl").select("question_id", "db_id", "level", "split")


@query
def write_baked(spark, sf):
    path = Workspace(spark).path("baked")
    writers.write_baked(_baked(spark, sf), path)
    return spark.read.parquet(path).select("prompt", "completion", "db_id", "teacher_sql", F.col("split").cast("string").alias("split"))


@query
def append_raw(spark, sf):
    path = Workspace(spark).path("raw")
    made = X.of(spark, sf, X.GENERATIONS)
    late = F.col("question_id").cast("bigint") % 2 == 1
    for part in (made.filter(~late), made.filter(late)):
        writers.append_raw(part, path)
    return readers.read_generations(spark, path).select("question_id", "raw_content")


@query
def materialize_if_absent(spark, sf):
    """Built once: the second builder is not asked."""
    path = Workspace(spark).path("levels")
    built = lambda: labelled(spark, sf).select("question_id", "level")
    writers.materialize_if_absent(spark, built, path)
    return writers.materialize_if_absent(spark, lambda: built().withColumn("level", F.lit("wrong")), path)


@query
def sorted_report(spark, sf):
    """A report in reading order, with its line numbers."""
    lines = reports.sorted_report(reports.level_distribution(labelled(spark, sf)))
    rows = lines.agg(F.collect_list(F.struct("level", "n")).alias("_rows"))
    return rows.select(F.posexplode("_rows").alias("line", "row")).select("line", "row.level", "row.n")


@query
def sample_databases(spark, sf):
    """First rows of stored tables, found below a root; one table is unreadable and left out."""
    root = Workspace(spark).path("databases")
    for db, name, key in (("geo", "nation", "n_nationkey"), ("shop", "part", "p_partkey"),
                          ("shop", "orders", "o_orderkey"), ("crm", "customer", "c_custkey")):
        stored = X.table(spark, sf, name).withColumn("photo", F.lit("x").cast("binary"))
        stored.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{root}/{db}/{name}")
    spark.createDataFrame([("no table",)], "value string").write.text(f"{root}/crm/broken.parquet")
    found = C.sample_databases(spark, readers.discover_databases(spark, root), 3)
    return found.select("db_id", "table_name", "row_no", F.array_join("header", ",").alias("header"), F.get("cells", F.lit(0)).alias("key"))


@query
def database_coverage(spark, sf):
    return reports.database_coverage(of_split(placed(spark, sf), S.TRAIN), domains(spark, sf).filter(F.col("domain") == S.IN_DOMAIN))


@query
def coverage_summary(spark, sf):
    few = placed(spark, sf).filter(F.col("level") == S.LEVEL_2)
    return reports.coverage_summary(reports.database_coverage(few, questions(spark, sf)))


# Text.


@query
def clean_sql(spark, sf):
    return X.of(spark, sf, X.DIRTY_SQL).select("o_orderkey", text.clean_sql(F.col("sql")).alias("cleaned"))


@query
def extract_with_reasoning(spark, sf):
    parts = text.extract_with_reasoning(F.col("raw_content"))
    return X.of(spark, sf, X.GENERATIONS).select("question_id", parts.alias("p")).select("question_id", "p.*")


@query
def extract_with_reasoning_documents(spark, sf):
    parts = text.extract_with_reasoning(F.col("raw_content"))
    return X.of(spark, sf, X.LONG_ANSWERS).select("question_id", parts.alias("p")).select("question_id", "p.*")


@query
def extract_sql(spark, sf):
    return X.of(spark, sf, X.GENERATIONS).select("question_id", text.extract_sql(F.col("raw_content")).alias("sql"))


@query
def extract_sql_documents(spark, sf):
    return X.of(spark, sf, X.LONG_ANSWERS).select("question_id", text.extract_sql(F.col("raw_content")).alias("sql"))


@query
def safe_id(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", text.safe_id(F.col("url")).alias("safe"))


@query
def canonical_name(spark, sf):
    return X.of(spark, sf, X.NAMES).select("p_partkey", text.canonical_name(F.col("name")).alias("canonical"))


@query
def quote_ident(spark, sf):
    return X.of(spark, sf, X.NAMES).select("p_partkey", text.quote_ident(F.col("name")).alias("quoted"))


@query
def truncate_cell(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", text.truncate_cell(F.col("text")).alias("cell"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    sql = text.extract_sql(F.col("raw_content")).alias("sql")
    made = X.of(spark, sf, X.GENERATIONS).select("question_id", sql)
    return made.join(questions(spark, sf).select("question_id", "db_id"), "question_id")


@query
def format_prediction(spark, sf):
    return format_predictions(_predictions(spark, sf))


@query
def parse_prediction(spark, sf):
    lines = format_predictions(_predictions(spark, sf)).select(F.to_json(F.create_map("question_id", "value")).alias("value"))
    return parse_predictions(lines)


@query
def submission_round_trip(spark, sf):
    """Predictions written as one object by many tasks, and read again line by line."""
    path = Workspace(spark).path("submission")
    writers.write_submission(_predictions(spark, sf), path, parts=8)
    return readers.read_submission(spark, path)


@query
def exact_match(spark, sf):
    padded = F.concat(F.lit(" "), F.col("text"), F.lit("\n"))
    other = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(padded)
    return X.table(spark, sf, "documents").select("doc_id", text.exact_match(F.col("text"), other).alias("same"))


# Catalog and schema text.


@query
def catalog_tables(spark, sf):
    return C.catalog_tables(catalog(spark, sf))


@query
def catalog_columns(spark, sf):
    return C.catalog_columns(catalog(spark, sf))


@query
def lookup_catalog(spark, sf):
    """Questions beside the number of tables of their database."""
    sizes = catalog(spark, sf).select("db_id", F.size("table_names_original").alias("tables"))
    return C.lookup_catalog(questions(spark, sf).select("question_id", "db_id"), sizes)


@query
def latest_catalog(spark, sf):
    """The last of many entries of a database: orders of a customer."""
    entries = X.table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("db_"), F.col("o_custkey").cast("string"))).alias("db_id"),
        F.col("o_totalprice").alias("entry"), F.col("o_orderkey").alias("position"),
    )
    return C.latest_catalog(entries)


@query
def primary_keys(spark, sf):
    keys = C.primary_keys(catalog(spark, sf))
    return keys.select("db_id", "pk_no", "table_name", F.array_join("columns", ", ").alias("columns"))


@query
def foreign_keys(spark, sf):
    return C.foreign_keys(catalog(spark, sf))


@query
def describe_tables(spark, sf):
    return C.describe_tables(catalog(spark, sf))


@query
def render_schema(spark, sf):
    return C.render_schema(catalog(spark, sf))


@query
def render_schema_with_rows(spark, sf):
    return contexts(spark, sf)


@query
def render_ddl(spark, sf):
    return C.render_ddl(catalog(spark, sf))


@query
def render_ddl_annotated(spark, sf):
    return C.render_ddl(catalog(spark, sf), annotate=True)


@query
def sample_tables(spark, sf):
    return samples(spark, sf).select("db_id", "table_idx", "row_no", F.array_join("cells", "|", "None").alias("cells"))


@query
def sample_rows(spark, sf):
    """The first rows of whole tables."""
    parts = [
        C.sample_rows(X.table(spark, sf, name), 3, [key]).select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"),
            C.readable_cell(F.col(value), X.table(spark, sf, name).schema[value].dataType).alias("value"),
        )
        for name, key, value in (
            ("nation", "n_nationkey", "n_name"), ("part", "p_partkey", "p_retailprice"),
            ("orders", "o_orderkey", "o_totalprice"), ("customer", "c_custkey", "c_acctbal"),
        )
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query
def render_table(spark, sf):
    """A small table for each order: its customer and price, and the status below it."""
    cells = lambda *names: F.array(*[F.col(name).cast("string") for name in names])
    rows = F.array(cells("o_custkey", "o_totalprice"), F.array(F.lit(None).cast("string"), F.col("o_orderpriority")))
    header = F.array(F.lit("who"), F.col("o_orderstatus"))
    return X.table(spark, sf, "orders").select("o_orderkey", tables.render_table(header, rows).alias("table"))


@query
def dedupe_columns(spark, sf):
    names = tables.dedupe_columns(F.col("names"))
    return X.of(spark, sf, X.QUERY_COLUMNS).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.array_join(names, ",").alias("unique_names")
    )


# Prompts.


@query
def choose_variant(spark, sf):
    chosen = prompts.choose_variant(X.of(spark, sf, X.PROMPT_VARIANTS), {3: "p3", 1: "p1", 0: "p0"}, 1000)
    return chosen.select("doc_id", "num_rows", "prompt", "prompt_status")


@query
def render_prompt(spark, sf):
    """Prompts within a budget that leaves some databases fewer sample rows, or none."""
    made = prompts.render_prompts(questions(spark, sf), stored_contexts(spark, sf), TEMPLATE, 1600, "Answer in SQL.")
    return made.select("question_id", "num_rows", "prompt", "prompt_status")


@query
def live_ddl(spark, sf):
    """DDL of stored tables, from their footers."""
    root = Workspace(spark).path("databases")
    for db, name in (("geo", "nation"), ("geo", "region"), ("shop", "part"), ("shop", "orders"), ("crm", "customer")):
        X.table(spark, sf, name).write.parquet(f"{root}/{db}/{name}")
    return C.live_ddl(spark, readers.discover_databases(spark, root))


@query
def render_prompt_from_file(spark, sf):
    """Prompts whose template is read from a file."""
    path = f"{Workspace(spark).path('template')}/text"
    spark.createDataFrame([(TEMPLATE.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    template = readers.load_template(spark, path)
    made = prompts.render_prompts(questions(spark, sf), stored_contexts(spark, sf), template, 1600, "Answer in SQL.")
    return made.select("question_id", "num_rows", "prompt", "prompt_status")


def _baked(spark: SparkSession, sf: str) -> DataFrame:
    merged = triage.merge_result(labelled(spark, sf), results(spark, sf)).filter(triage.is_success())
    third = F.pmod(F.col("question_id").cast("bigint"), F.lit(5))
    split = F.when(third == 0, S.VAL_IN).when(third == 1, S.VAL_OUT).otherwise(S.TRAIN)
    return prompts.bake(merged.withColumn("split", split), stored_contexts(spark, sf), TEMPLATE)


@query
def bake(spark, sf):
    return _baked(spark, sf)


@query
def combined_val(spark, sf):
    return prompts.combined_val(_baked(spark, sf))


@query
def length_audit(spark, sf):
    return prompts.length_audit(X.table(spark, sf, "documents"), "text", 1000, by=["lang"])


@query
def truncate_left(spark, sf):
    cut = prompts.truncate_left(F.col("text"), 100)
    return X.table(spark, sf, "documents").select("doc_id", cut.alias("tail"))


# Comparison and scores.


@query
def compare_results(spark, sf):
    named = {name: F.array_join(name, ",") for name in ("gold_cols", "predicted_cols")}
    return compared(spark, sf).withColumns(named)


@query
def set_equal(spark, sf):
    """The orders and customers of all line items, found from either table; and parts against suppliers."""
    items, orders = X.table(spark, sf, "lineitem"), X.table(spark, sf, "orders")
    # Both joins and their comparison are one stage, and keys are few bytes: tasks are counted, not coalesced by size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = items.repartition(tasks, "l_orderkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("l_orderkey", "o_custkey")
    met = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")
    rows = [
        compare.set_equal(joined, met).withColumn("case", F.lit("orders")),
        compare.set_equal(items.select("l_partkey"), items.select("l_suppkey")).withColumn("case", F.lit("parts")),
        compare.set_equal(items.select("l_partkey"), X.table(spark, sf, "part").select("p_partkey")).withColumn("case", F.lit("all parts")),
    ]
    return rows[0].union(rows[1]).union(rows[2])


def _scored(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    made = X.of(spark, sf, X.GENERATIONS).select("question_id", F.col("raw_content").alias("predicted_sql"))
    wanted = X.of(spark, sf, "SELECT CAST(o_orderkey AS STRING) AS question_id, concat('SELECT ', CAST(o_custkey AS STRING)) AS gold_sql FROM {orders}")
    known = labelled(spark, sf).select("question_id", "level")
    joined = E.join_references(made, wanted).join(known, "question_id")
    return E.evaluate(joined, compared(spark, sf).withColumnRenamed("pair_id", "question_id"), by)


@query
def evaluate(spark, sf):
    return _scored(spark, sf, [])


@query
def evaluate_by_level(spark, sf):
    return _scored(spark, sf, ["level"])


# Model output and streams.


def _echo():
    """A stand-in model: it repeats the last line of the question as a statement."""

    def answer(prompts_):
        return [f"plan\n```sql\nSELECT '{prompt}'\n```" for prompt in prompts_]

    return answer


@query
def generate_stub(spark, sf):
    asked = questions(spark, sf).select("question_id", F.col("question").alias("prompt"))
    return extract_responses(generate(asked, _echo, 64)).select("question_id", "predicted_sql", "final_reasoning", "generation_status")


def _unsteady():
    """A stand-in model whose first call for each batch fails, and every call with a number divisible by seven."""
    calls = []

    def answer(prompts_):
        calls.append(prompts_)
        if prompts_ != calls[-2:][0] or len(calls) == 1 or any(int(p.split()[-1]) % 7 == 0 for p in prompts_):
            raise ValueError("down")
        return [f"plan\n```sql\nSELECT '{prompt}'\n```" for prompt in prompts_]

    return answer


@query
def generate_failing(spark, sf):
    """A model that fails: each batch is sent again, and one that never succeeds becomes an error row."""
    asked = questions(spark, sf).select("question_id", F.col("question").alias("prompt"))
    made = extract_responses(generate(asked, _unsteady, 1, attempts=3, delay=0))
    return made.select("question_id", "predicted_sql", "generation_status", "error_message")


@query
def generate_logged(spark, sf):
    """Questions that share prompts, through a log: a second model is asked only what the first one left open."""
    log = AnswerLog(spark, Workspace(spark).path("answers"))
    asked = X.of(spark, sf, X.OWNERS).select(
        "question_id", F.concat(F.lit("customer "), F.substring("db_id", 3, 20)).alias("prompt"))
    log.generate(asked, _unsteady, 1, attempts=2, delay=0)
    late = lambda: lambda prompts_: [f"late {prompt}" for prompt in prompts_]
    return log.generate(asked, late, 64)


@query
def verify_candidates_joined(spark, sf):
    made = X.of(spark, sf, X.GENERATIONS).select(
        "question_id", "raw_content", F.lit(S.SUCCESS).alias("generation_status"), F.lit(None).cast("string").alias("error_message")
    )
    raw = X.of(spark, sf, X.RESULT_ROWS)
    rows = compare.result_rows(raw, F.col("pair_id"), F.col("side"), ["c1", "c2"])
    runs = X.of(spark, sf, X.EXECUTIONS).withColumn("pair_id", F.col("pair_id").cast("string"))
    checked = verify_candidates(pool(spark, sf, S.CACHE_CANDIDATE), made, rows, runs)
    return checked.select("question_id", "level", "predicted_sql", "generation_status", "execution_match", "predicted_exec_status", "error_message")


@query
def stream_ingest_orders(spark, sf):
    """The table of orders as a stream of generations, some questions answered twice."""
    workspace = Workspace(spark)
    schema = X.table(spark, sf, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    raw = spark.sql(X.GENERATIONS, orders=stream)
    target = workspace.path("ingested")
    stream_ingest(spark, raw, target, workspace.path("progress")).awaitTermination()
    return read_ingested(spark, target)


@query
def stream_level_count(spark, sf):
    """Running label counts over the table of orders as a stream."""
    workspace = Workspace(spark)
    schema = X.table(spark, sf, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    counts = stream_level_counts(spark.sql(X.QUESTIONS, orders=stream))
    target = workspace.path("counts")
    run = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
        .option("checkpointLocation", workspace.path("progress")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("level string, n bigint").parquet(target)
