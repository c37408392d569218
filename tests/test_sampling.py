"""Ranks, quotas and fills against plain loops; invariants of a curation."""

import random

import pytest
from pyspark.sql import functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.keys import shuffle_key
from sqlcorpus.operators import fill, quota
from sqlcorpus.operators.ranking import rank_by_key, rank_by_order
from sqlcorpus.plans.curate import Settings, curate, curate_in_domain, run_curation
from sqlcorpus.plans.pools import SUCCESS_POOL, store_pools
from sqlcorpus.plans.waves import AskedPool, verify_in_waves
from sqlcorpus.sources.readers import read_curated
from sqlcorpus.session import Workspace
from workload import queries as Q

from .conftest import SF_SMALL

LEVELS = S.LEVELS[:4]


def python_key(question_id, seed=42):
    import hashlib

    return hashlib.md5(f"{seed}:{question_id}".encode()).hexdigest()


def test_rank_by_key_equals_a_window(spark):
    rows = [(str(i), "ab"[i % 2]) for i in range(500)] + [("7", "b")] * 50
    df = spark.createDataFrame(rows, "id string, g string").withColumn("key", shuffle_key(F.col("id")))
    expected = {}
    for group in "ab":
        mine = sorted((python_key(i), i) for i, g in rows if g == group)
        expected[group] = [i for _, i in mine]
    for limit in (None, 1, 40, 300):
        ranked = rank_by_key(df, "key", ["g"], ["id"], limit, digits=1).collect()
        for group in "ab":
            got = [row["id"] for row in sorted(ranked, key=lambda r: r["rank"]) if row["g"] == group]
            assert got == expected[group][:limit]
    totals = rank_by_key(df, "key", total="n").select("n").distinct().collect()
    assert [row["n"] for row in totals] == [550]


def test_rank_by_order(spark):
    numbers = list(range(-100, 900, 3))
    random.Random(1).shuffle(numbers)
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    ranks = {row["n"]: row["rank"] for row in rank_by_order(df, "n", buckets=7).collect()}
    assert ranks == {n: i + 1 for i, n in enumerate(sorted(numbers))}


def test_rank_by_order_keeps_rows_without_a_value(spark):
    rows = [(n if n % 3 else None, n) for n in range(200)] + [(7, 999), (7, 998)]
    df = spark.createDataFrame(rows, "n bigint, other int")
    for buckets in (None, 5):
        ranked = sorted(rank_by_order(df, "n", buckets=buckets).collect(), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(rows) + 1))
        valued = [r["n"] for r in ranked if r["n"] is not None]
        assert valued == sorted(n for n, _ in rows if n is not None)
        assert all(r["n"] is None for r in ranked[len(valued):])
    assert rank_by_order(df.filter("n < 0"), "n").count() == 0
    assert [r["rank"] for r in rank_by_order(df.filter("n IS NULL").limit(3), "n").orderBy("rank").collect()] == [1, 2, 3]


def test_a_hot_value_is_ranked_in_many_tasks(spark):
    """A third of all rows share one value, a sixth have none: no window partition holds more than its even share."""
    rows = [(i % 1000 if i % 3 else 7, i) for i in range(30_000)] + [(None, i) for i in range(6000)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "n bigint, other int").repartition(4)
    ranked = rank_by_order(df, "n", buckets=18)
    got = sorted((r["rank"], r["n"]) for r in ranked.collect())
    assert [r for r, _ in got] == list(range(1, len(rows) + 1))
    assert [n for _, n in got] == sorted((n for n, _ in rows), key=lambda n: (n is None, n or 0))
    again = {r["other"]: r["rank"] for r in rank_by_order(df.repartition(7), "n", buckets=18).filter("n = 7").collect()}
    assert again == {r["other"]: r["rank"] for r in ranked.filter("n = 7").collect()}
    # Without the last window, the same plan tells which bucket each row falls into.
    text = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright(_digest" in text
    sizes = bucket_sizes(ranked)
    assert max(sizes) < 2.5 * len(rows) / 18 and len(sizes) > 18


def bucket_sizes(ranked):
    """Rows of each partition of the window that gives the ranks, from the sort below it."""
    from pyspark.sql import DataFrame

    plan = ranked._jdf.queryExecution().analyzed()
    while "Window" not in plan.nodeName():
        plan = plan.children().apply(0)
    below = DataFrame(ranked.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(
        ranked.sparkSession._jsparkSession, plan.children().apply(0)), ranked.sparkSession)
    return [r["count"] for r in below.groupBy("_bucket").count().collect()]


def python_targets(size, shares, strict):
    targets = {name: round(share * size) for name, share in shares.items()}
    names = [name for name in targets if strict or shares[name] > 0]
    rest = size - sum(targets.values())
    names.sort(key=lambda name: targets[name], reverse=rest < 0)
    for i in range(abs(rest)):
        targets[names[i % len(names)]] += 1 if rest > 0 else -1
    return targets


@pytest.mark.parametrize("strict", [False, True])
def test_target_counts(spark, strict):
    sizes = [0, 1, 2, 3, 5, 10, 150, 350, 1000, 1001, 2000, 2001, 7777]
    df = spark.createDataFrame([(n,) for n in sizes], "size bigint")
    for shares in (S.LEVEL_SHARES, {"a": 0.15, "b": 0.15, "c": 0.3, "d": 0.35, "e": 0.0, "f": 0.05}):
        got = {n: {} for n in sizes}
        for row in quota.target_counts(df, shares=shares, strict_compat=strict).collect():
            got[row["size"]][row["level"]] = row["target"]
        assert got == {n: python_targets(n, shares, strict) for n in sizes}
    five = python_targets(5, S.LEVEL_SHARES, strict)
    assert five[S.LEVEL_OTHER] == (1 if strict else 0)


def test_slots_equal_the_greedy_walk(spark):
    """Each next row goes to the split with the lower fill ratio, to train on ties."""
    rng = random.Random(3)
    cases = []
    for i in range(150):
        tt, vt = rng.randint(0, 40), rng.randint(0, 25)
        cases.append((f"case {i}", rng.randint(0, tt + 2), tt, rng.randint(0, vt + 2), vt))
    got = {name: [] for name, *_ in cases}
    levels = {name: numbers for name, *numbers in cases}
    open_places = {name: max(0, tt - tc) + max(0, vt - vc) for name, tc, tt, vc, vt in cases}
    slots = [(name, i + 1) for name, n in open_places.items() for i in range(n)]
    split, position = fill.places(levels)
    frame = spark.createDataFrame(slots, "level string, slot bigint").select("level", "slot", split.alias("split"), position.alias("position"))
    positions = {}
    for row in frame.orderBy("level", "slot").collect():
        got[row["level"]].append((row["slot"], row["split"]))
        positions.setdefault((row["level"], row["split"]), []).append(row["position"])
    assert all(found == list(range(1, len(found) + 1)) for found in positions.values())
    for name, tc, tt, vc, vt in cases:
        walk = []
        while tc < tt or vc < vt:
            train_ratio = tc / tt if tt > 0 else 1
            val_ratio = vc / vt if vt > 0 else 1
            if tc < tt and (train_ratio <= val_ratio or vc >= vt):
                tc += 1
                walk.append(S.TRAIN)
            else:
                vc += 1
                walk.append(S.VAL_IN)
        assert got[name] == [(i + 1, split) for i, split in enumerate(walk)], name


def python_dual(pool, targets, val_targets):
    train, val = [], []
    for level in LEVELS:
        tc = vc = 0
        for question_id in sorted((q for q, lv in pool if lv == level), key=lambda q: (python_key(q), q)):
            tt, vt = targets[level], val_targets[level]
            if tc >= tt and vc >= vt:
                break
            if (tc / tt if tt else 1) <= (vc / vt if vt else 1) and tc < tt:
                train.append(question_id)
                tc += 1
            elif vc < vt:
                val.append(question_id)
                vc += 1
    return set(train), set(val)


def test_fill_dual_equals_the_greedy_loop(spark):
    rng = random.Random(5)
    pool = [(str(i), rng.choice(S.LEVELS)) for i in range(400)]
    targets = {level: rng.randint(0, 60) for level in LEVELS}
    val_targets = {level: rng.randint(1, 30) for level in LEVELS}
    df = spark.createDataFrame([(q, "db", level) for q, level in pool], "question_id string, db_id string, level string")
    rows = fill.fill_dual(df, targets, val_targets).collect()
    train = {row["question_id"] for row in rows if row["split"] == S.TRAIN}
    val = {row["question_id"] for row in rows if row["split"] == S.VAL_IN}
    assert (train, val) == python_dual(pool, targets, val_targets)


def test_negative_needs_add_nothing(spark):
    df = spark.createDataFrame([("1", "db", LEVELS[0])], "question_id string, db_id string, level string")
    assert fill.backfill_dual(df, -5, 0).count() == 0
    rows = fill.backfill_dual(df, -5, 3).collect()
    assert [row["split"] for row in rows] == [S.TRAIN]


def curated(spark, workspace, settings=Q.SMALL, existing=None, partitions=None):
    parts = [Q.questions(spark, SF_SMALL), Q.results(spark, SF_SMALL), Q.responses(spark, SF_SMALL)]
    if partitions:
        parts = [df.orderBy(F.rand(9)).repartition(partitions) for df in parts]
    return curate(workspace, *parts, settings, existing)


MEDIUM = Settings(train_size=600, val_in_size=80, val_out_size=160)


def test_every_stage_adds_rows(spark, workspace):
    stages = {(r["split"], r["stage"]) for r in curated(spark, workspace, MEDIUM).select("split", "stage").distinct().collect()}
    assert {(S.TRAIN, "1"), (S.TRAIN, "2"), (S.VAL_IN, "1"), (S.VAL_OUT, "1"), (S.VAL_OUT, "2")} <= stages
    assert {stage for _, stage in stages} >= {"1", "2", "3", "4"}
    small = {r["stage"] for r in curated(spark, workspace, Q.SMALL).collect()}
    assert "3.1" in small


def test_curation_invariants(spark, workspace):
    rows = curated(spark, workspace, MEDIUM).collect()
    ids = [row["question_id"] for row in rows]
    assert len(ids) == len(set(ids))
    inside = {row["db_id"] for row in rows if row["split"] != S.VAL_OUT}
    outside = {row["db_id"] for row in rows if row["split"] == S.VAL_OUT}
    assert not inside & outside
    sizes = {split: sum(row["split"] == split for row in rows) for split in S.SPLITS}
    assert sizes[S.TRAIN] <= 1.2 * MEDIUM.train_size
    assert sizes[S.VAL_IN] <= MEDIUM.val_in_size
    assert sizes[S.VAL_OUT] <= 1.2 * MEDIUM.val_out_size
    good = {r[0] for r in Q.triaged(spark, SF_SMALL).filter("cache_state = 'success'").select("question_id").collect()}
    good |= {
        r[0] for r in fill.verified(Q.triaged(spark, SF_SMALL), Q.responses(spark, SF_SMALL)).select("question_id").collect()
    }
    assert set(ids) <= good


def test_rerun_with_its_own_output_adds_nothing(spark, workspace):
    first = curated(spark, workspace, Q.SMALL)
    again = curated(spark, workspace, Q.SMALL, existing=first)
    key = lambda rows: sorted((r["question_id"], r["split"]) for r in rows.collect())
    assert key(again) == key(first)


def test_partitions_and_order_do_not_matter(spark, workspace):
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    expected = key(curated(spark, workspace, Q.SMALL))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for count in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(count))
            assert key(curated(spark, workspace, Q.SMALL, partitions=count)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_without_responses_only_the_cache_is_used(spark, workspace):
    rows = curate(workspace, Q.questions(spark, SF_SMALL), Q.results(spark, SF_SMALL), None, MEDIUM)
    assert {row["stage"] for row in rows.select("stage").distinct().collect()} <= {"1", "3"}


def test_resumed_surplus_binds_the_total(spark, workspace):
    level = LEVELS[0]
    held = spark.createDataFrame(
        [(f"h{i}", "db", S.LEVEL_OTHER, S.TRAIN) for i in range(6)], "question_id string, db_id string, level string, split string"
    )
    pool = spark.createDataFrame([(str(i), "db", level) for i in range(50)], "question_id string, db_id string, level string")
    placed = pool.withColumns({"domain": F.lit(S.IN_DOMAIN), "state": F.lit(SUCCESS_POOL)})
    success = store_pools(workspace, placed, S.LEVELS, 42)[S.IN_DOMAIN, SUCCESS_POOL]
    rows = curate_in_domain(workspace, success, None, {level: 10}, {level: 2}, 1, existing=held)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert counts == {S.TRAIN: 10, S.VAL_IN: 2}


def test_waves_lead_to_the_same_fill(spark, workspace):
    candidates = workspace.table(Q.triaged(spark, SF_SMALL).filter("cache_state = 'candidate'"), "candidates")
    answers = Q.responses(spark, SF_SMALL)
    need = {level: 15 for level in LEVELS}
    asked = []

    def verify(df):
        asked.append(df.count())
        return df.join(answers, "question_id")

    got = verify_in_waves(workspace, candidates, verify, need, oversample=1.1)
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    targets = {**need, S.LEVEL_OTHER: 0}
    assert key(fill.verify_fill_single(candidates, got, targets)) == key(fill.verify_fill_single(candidates, answers, targets))
    assert sum(asked) < candidates.count() and len(asked) > 1


def test_thousands_of_databases_are_asked_in_one_table(spark, workspace, monkeypatch):
    """Needs of 5,000 databases, one of which holds a third of all candidates, never reach the driver."""
    rows = spark.range(20_000).select(
        F.col("id").cast("string").alias("question_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 5000)).alias("db_id"),
        F.lit(S.LEVEL_1).alias("level"))
    rows = workspace.table(rows, "rows")
    asked = []

    def verify(df):
        asked.append(df.count())
        good = F.pmod(F.xxhash64("question_id"), F.lit(2)) == 0
        return df.select("question_id", "level", F.lit(S.SUCCESS).alias("generation_status"), good.alias("execution_match"))

    filled = spark.createDataFrame([("x", "d1"), ("y", "d1"), ("z", "d2")], "question_id string, db_id string")
    lengths, collect = [], type(rows).collect

    def watched(df):
        out = collect(df)
        lengths.append(len(out))
        return out

    monkeypatch.setattr(type(rows), "collect", watched)
    pool = AskedPool(workspace, rows, verify)
    found = pool.ask_databases(filled, 2)
    assert max(lengths) <= 8
    monkeypatch.undo()
    got = {r["db_id"]: r["n"] for r in found.groupBy("db_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = rows.where(F.pmod(F.xxhash64("question_id"), F.lit(2)) == 0)
    held = {"d1": 2, "d2": 1}
    want = {r["db_id"]: min(r["n"], 2 - held.get(r["db_id"], 0)) for r in good.groupBy("db_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(got.get(d, 0) >= n for d, n in want.items()) and "d1" not in got
    assert sum(asked) < 0.9 * rows.count() and got["hot"] < 20
    by_all = fill.cover_dual(rows, verify(rows), filled, 20_000, 0, 5001)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(fill.cover_dual(found, None, filled, 20_000, 0, 5001)) == key(by_all)


def test_labels_count_as_passed_for_any(spark, workspace):
    """A request regardless of label ends as soon as enough have passed."""
    rows = workspace.table(spark.range(2000).select(
        F.col("id").cast("string").alias("question_id"), F.lit("d").alias("db_id"), F.lit(S.LEVEL_1).alias("level")), "rows")
    asked = []

    def verify(df):
        asked.append(df.count())
        return df.select("question_id", "level", F.lit(S.SUCCESS).alias("generation_status"), F.lit(True).alias("execution_match"))

    assert AskedPool(workspace, rows, verify).ask_any(100).count() == sum(asked) == 150


def test_run_curation_stores_full_records(spark, workspace):
    path = workspace.path("curated")
    responses = Q.responses(spark, SF_SMALL).withColumn("predicted_sql", F.lit("SELECT 9"))
    run_curation(
        workspace, Q.questions(spark, SF_SMALL), Q.results(spark, SF_SMALL), responses, path, Q.SMALL
    )
    rows = read_curated(spark, path)
    expected = curated(spark, Workspace(spark), Q.SMALL)
    assert rows.count() == expected.count()
    assert rows.filter("question is null or predicted_sql is null or not execution_match").count() == 0
    assert read_curated(spark, path, S.VAL_IN).select("split").distinct().collect()[0][0] == S.VAL_IN
    # A second run finds its splits full; a larger one keeps what is stored and adds to it.
    run_curation(
        Workspace(spark), Q.questions(spark, SF_SMALL), Q.results(spark, SF_SMALL), responses, path, Q.SMALL
    )
    assert read_curated(spark, path).count() == expected.count()
    run_curation(
        Workspace(spark), Q.questions(spark, SF_SMALL), Q.results(spark, SF_SMALL), responses, path, MEDIUM
    )
    grown = read_curated(spark, path)
    assert grown.select("question_id").distinct().count() == grown.count() > expected.count()


def test_large_heads_lead_to_the_same_rows(spark, workspace, monkeypatch):
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    expected = key(curated(spark, workspace, MEDIUM))
    monkeypatch.setattr("sqlcorpus.plans.pools.FEW_ROWS", 0)
    monkeypatch.setattr("sqlcorpus.operators.fill.BROADCAST_ROWS", 0)
    assert key(curated(spark, workspace, MEDIUM)) == expected


def test_heads_hold_the_first_rows(spark, workspace):
    rows = [(str(i), "db", S.LEVELS[i % 5], S.IN_DOMAIN, SUCCESS_POOL) for i in range(3000)]
    df = spark.createDataFrame(rows, "question_id string, db_id string, level string, domain string, state string")
    pool = store_pools(workspace, df, LEVELS, 42)[S.IN_DOMAIN, SUCCESS_POOL]
    first = sorted((python_key(q), q) for q, _, level, *_ in rows if level == LEVELS[0])
    head = {r["question_id"] for r in pool.head({LEVELS[0]: 20}, 5)[0].collect()}
    assert {q for _, q in first[:25]} <= head and len(head) < 40
    every = sorted((python_key(q), q) for q, *_ in rows)
    head = {r["question_id"] for r in pool.head_of_all(100, 0)[0].collect()}
    assert {q for _, q in every[:100]} <= head and len(head) < 110
    assert pool.head_of_all(5000, 0)[0].count() == 3000
    # A file holds one range of keys, so a smaller head opens fewer files.
    opened = [len(pool.head_of_all(n, 0)[0].inputFiles()) for n in (10, 1000, 2000, 3000)]
    assert opened == sorted(opened) and opened[0] == 1 and opened[-1] == len(pool.files) == 4
    ranges = sorted((r["low"], r["high"]) for r in pool.rows.groupBy(F.col("_metadata.file_path")).agg(
        F.min("_key").alias("low"), F.max("_key").alias("high")).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert "PushedFilters" in (text := pool.head_of_all(10, 0)[0]._jdf.queryExecution().executedPlan().toString())
    assert "LessThan(_key" in text
