"""Physical plans: what must, and must not, appear in them."""

import re

import pytest
from pyspark.sql import functions as F

from sqlcorpus import schemas as S
from sqlcorpus.operators.ranking import rank_by_key
from sqlcorpus.operators import catalog as C, fill
from sqlcorpus.operators.triage import triage
from sqlcorpus.sources.readers import with_file_position
from workload import fixtures as X, queries as Q

from .conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["fill_single", "fill_dual", "verify_fill_dual", "backfill_dual", "cover_dual", "bake", "render_prompt"])
def test_no_cross_products(spark, name):
    text = plan(Q.REGISTERED[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ranks_never_gather_a_label_in_one_task(spark):
    """Rows are ranked by label and bucket; a window over a label alone sees bucket counts only."""
    pool = Q.pool(spark, SF_SMALL, S.CACHE_SUCCESS)
    text = plan(fill.fill_single(pool, Q.even(400)))
    windows = [line for line in text.splitlines() if re.search(r"Window \[", line)]
    rows = [line for line in windows if "question_id" in line]
    assert rows and all(re.search(r"\[level#\d+, _bucket#\d+\]", line) for line in rows)
    assert "SinglePartition" not in text


def test_global_rank_gathers_counts_only(spark):
    pool = Q.pool(spark, SF_SMALL, S.CACHE_SUCCESS)
    text = plan(fill.backfill_single(pool, 100))
    below = text.split("SinglePartition", 1)
    assert len(below) == 2 and "HashAggregate(keys=" in below[1].splitlines()[1]


def test_coverage_limits_before_the_shuffle(spark):
    text = plan(Q.cover_dual(spark, SF_SMALL))
    assert text.count("WindowGroupLimit") >= 2


def test_catalog_entries_are_spread_before_they_are_sorted(spark):
    """One task may read all entries; it sorts none of them, and no name gathers its entries before they are merged."""
    entries = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["y"]), ("b", 3, ["z"])], "db_id string, position int, names array<string>")
    last = C.latest_catalog(entries.coalesce(1))
    text = plan(last)
    spread = [at for at, line in enumerate(text.splitlines()) if re.search(r"hashpartitioning\(db_id#\d+, position#\d+, \d+\)", line)]
    sorts = [at for at, line in enumerate(text.splitlines()) if re.search(r"\bSort \[", line)]
    assert spread and sorts and max(sorts) < spread[0]
    assert sorted(map(tuple, last.collect())) == [("a", ["y"]), ("b", ["z"])]


def test_set_equal_counts_its_tasks(spark, no_broadcast):
    """Two joins and their comparison are one stage: one side is dealt out by number, so the stage is not coalesced by size."""
    text = plan(Q.set_equal(spark, SF_SMALL))
    dealt = re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L, \d+\), (\w+)", text)
    assert text.count("SortMergeJoin") == 2 and dealt == ["REPARTITION_BY_NUM"] * 2


@pytest.mark.parametrize("position", ["at", "0"])
def test_sorted_catalog_entries_stay_in_counted_tasks(spark, position):
    """Tasks that sort entries are not coalesced by compressed size, also if all entries have one position."""
    rows = [("a", 1, ["x"]), ("a", 1, ["x"]), ("b", 3, ["z"]), (None, 4, ["w"]), ("", 5, ["w"])]
    entries = spark.createDataFrame(rows, "db_id string, at int, names array<string>").withColumn("position", F.expr(position))
    last = C.latest_catalog(entries.drop("at"))
    text = plan(last)
    assert text.count("REPARTITION_BY_NUM") == text.count("Exchange") == 2
    assert sorted(map(tuple, last.collect())) == [("a", ["x"]), ("b", ["z"])]


def test_last_catalog_entry_of_many(spark):
    """A name's entries meet over several shares; an entry without a position is passed over, and null if alone."""
    rows = [("a", at, [str(at)]) for at in range(500)] + [("a", None, ["x"]), ("b", None, ["y"])]
    entries = spark.createDataFrame(rows, "db_id string, position int, names array<string>")
    assert sorted(map(tuple, C.latest_catalog(entries).collect())) == [("a", ["499"]), ("b", None)]


def test_samples_limit_before_the_shuffle(spark):
    assert plan(Q.samples(spark, SF_SMALL)).count("WindowGroupLimit") == 2


def test_catalog_text_is_made_without_a_shuffle(spark):
    catalog = Q.catalog(spark, SF_SMALL)
    for df in (C.render_schema(catalog), C.render_ddl(catalog), C.catalog_columns(catalog), C.foreign_keys(catalog)):
        assert "Exchange" not in plan(df)


def test_file_positions_shuffle_counts_only(spark):
    text = plan(with_file_position(X.table(spark, SF_SMALL, "orders").select("o_orderkey", "_metadata"), "parquet"))
    rows = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert all("_file" in line for line in rows) and "Sort [o_orderkey" not in text


def test_triage_joins_narrow_rows(spark, no_broadcast):
    text = plan(triage(Q.labelled(spark, SF_SMALL), Q.results(spark, SF_SMALL)))
    assert "SortMergeJoin" in text
    assert not re.search(r"Exchange.*question#", text)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert scans and all("o_totalprice" not in scan for scan in scans)


def test_a_hot_database_can_be_split(spark, no_broadcast):
    """Questions meet stored contexts in a plain sort-merge join, which adaptive execution can split."""
    asked = Q.questions(spark, SF_SMALL)
    text = plan(asked.join(Q.stored_contexts(spark, SF_SMALL), "db_id", "left"))
    tail = text.split("SortMergeJoin", 1)[1]
    assert tail.count("Exchange hashpartitioning(db_id") == 2 and "Aggregate" not in tail


def test_pair_sums_are_partial(spark, no_broadcast):
    text = plan(Q.compared(spark, SF_SMALL))
    assert re.search(r"Exchange hashpartitioning\(pair_id#\d+, _row#\d+", text)
    assert "partial_min" in text and "partial_sum" in text


def test_a_hot_question_is_ranked_exactly(spark):
    rows = [("hot", "d", S.LEVEL_1)] * 2000 + [(str(i), "d", S.LEVEL_1) for i in range(50)]
    pool = spark.createDataFrame(rows, "question_id string, db_id string, level string")
    assert fill.fill_single(pool, {S.LEVEL_1: 2030}).count() == 2030
    text = plan(fill.fill_single(pool, {S.LEVEL_1: 100}))
    assert re.search(r"HashAggregate\(keys=\[.*question_id.*partial_count", text)
    hot = fill.fill_single(pool, {S.LEVEL_1: 2050}).filter(F.col("question_id") == "hot")
    assert hot.count() == 2000


def test_ranks_of_any_number_of_groups_share_one_plan(spark):
    """The plan for 100,000 groups is that for one: bounds are a table, joined to bucket counts before rows move."""
    rows = spark.range(400_000).select(
        (F.col("id") % 100_000).cast("string").alias("g"), F.md5(F.col("id").cast("string")).alias("_key"))
    between = rows.select("g").distinct().select("g", F.lit(2).alias("first"), F.lit(3).alias("last"))
    ranked = rank_by_key(rows, "_key", ["g"], between=between)
    text = plan(ranked)
    assert "CASE WHEN" not in text and len(text) < 20_000
    assert ranked.groupBy("rank").count().orderBy("rank").collect() == [(2, 100_000), (3, 100_000)]
