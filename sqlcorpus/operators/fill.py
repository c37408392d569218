"""Quota sampling: each stage of a curation as ranks and joins.

Walking a shuffled list and taking rows while there is room equals taking the first ranks in the
shuffled order, so every stage is exact and depends on neither partitions nor arrival order.

A pool has the columns ``question_id, db_id, level``; stages add ``split`` and ``stage``. ``few`` says
that a pool is known to hold no more rows than one task can rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.keys import shuffle_key
from sqlcorpus.functions.labels import level_rank
from sqlcorpus.operators.ranking import rank_by_key, rank_few
from sqlcorpus.session import BROADCAST_ROWS

PICKED = ["question_id", "db_id", "level", "split", "stage"]
TIES = ["question_id", "db_id", "level"]
KEY = "_key"


def _keyed(pool: DataFrame, seed: int) -> DataFrame:
    return pool.select("question_id", "db_id", "level", shuffle_key(F.col("question_id"), seed).alias(KEY))


def _ranker(few: bool):
    return rank_few if few else rank_by_key


def without(df: DataFrame, *used: DataFrame | None) -> DataFrame:
    """Rows whose question is in none of the given tables."""
    ids = None
    for table in used:
        if table is not None:
            column = table.select(F.col("question_id").cast("string").alias("question_id"))
            ids = column if ids is None else ids.union(column)
    return df if ids is None else df.join(ids, "question_id", "left_anti")


def level_counts(filled: DataFrame | None, levels: list[str] | None = None) -> dict[str, int]:
    """Rows a split holds by label; labels other than ``levels``, where given, count together as one."""
    if filled is None:
        return {}
    level = F.col("level")
    if levels is not None:
        level = F.when(level.isin(levels), level).otherwise(F.lit(""))
    rows = filled.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return {row["level"]: row["n"] for row in rows.collect()}


def needs(targets: dict[str, int], held: dict[str, int]) -> dict[str, int]:
    """Rows each label still needs, labels without need left out."""
    return {level: n - held.get(level, 0) for level, n in targets.items() if n > held.get(level, 0)}


def number_of(level: Column, numbers: dict[str, int]) -> Column:
    """The number a label is mapped to, 0 for other labels."""
    number = F.lit(0)
    for name, value in numbers.items():
        number = F.when(level == name, value).otherwise(number)
    return number.cast("bigint")


def _capped(filled: DataFrame, rooms: dict[str, int]) -> DataFrame:
    """Each split cut to its room, in label order, then by rank.

    Counts of a few labels set the cut-offs.
    """
    running = Window.partitionBy("split").orderBy(level_rank(F.col("level")))
    before = F.coalesce(F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = filled.groupBy("split", "level").agg(F.count(F.lit(1)).alias("_n"))
    allowed = counts.select("split", "level", (number_of(F.col("split"), rooms) - before).alias("_allowed"))
    # One row a label of the quota.
    kept = filled.join(F.broadcast(allowed), ["split", "level"])
    return kept.filter(F.col("position") <= F.col("_allowed")).drop("_allowed")


def _picked(df: DataFrame, stage: str, split: Column | None = None) -> DataFrame:
    if split is not None:
        df = df.withColumn("split", split)
    return df.withColumn("stage", F.lit(stage)).select(*PICKED)


def _nothing(pool: DataFrame) -> DataFrame:
    none = pool.limit(0).select(*[F.col(name).cast("string") for name in TIES])
    return none.select(*TIES, F.lit("").alias("split"), F.lit("").alias("stage"))


def fill_single(
    pool: DataFrame,
    targets: dict[str, int],
    split: str = S.VAL_OUT,
    existing: DataFrame | None = None,
    locked: DataFrame | None = None,
    seed: int = 42,
    stage: str = "1",
    few: bool = False,
    held: dict[str, int] | None = None,
) -> DataFrame:
    """Fill one split by label from a pool, up to the targets and their sum.

    ``held`` gives the rows of ``existing`` by label, where they are known.
    """
    held = level_counts(existing, list(targets)) if held is None else held
    need = needs(targets, held)
    room = sum(targets.values()) - sum(held.values())
    if not need or room <= 0:
        return _nothing(pool)
    limit = number_of(F.col("level"), need)
    rows = without(_keyed(pool.filter(F.col("level").isin(list(need))), seed), locked, existing)
    ranked = _ranker(few)(rows, KEY, ["level"], TIES, limit, rank="position")
    if sum(need.values()) > room:
        ranked = _capped(ranked.withColumn("split", F.lit(split)), {split: room})
    return _picked(ranked, stage, F.lit(split))


def places(levels: dict[str, tuple[int, int, int, int]]) -> tuple[Column, Column]:
    """(split, position) of the column ``slot``, the number of a place in the order in which two splits fill up.

    ``levels`` maps a label to what train holds and should hold, and the same of validation. The next place goes to
    the split with the lower fill ratio, to train on ties. Filled from nothing, the first ``p`` places hold
    ``(p - 1) * T div (T + V) + 1`` of train. A split that lags behind is filled alone at first, up to the ratio of the
    other; from there on, places follow that order, of which train and validation together have filled ``slot`` plus
    what they held.
    """
    numbers: dict[str, dict[str, int]] = {name: {} for name in ("tc", "tt", "vc", "vt", "train_first", "val_first")}
    for level, (tc, tt, vc, vt) in levels.items():
        tc, vc = min(tc, tt), min(vc, vt)
        # Places of one split at a ratio not beyond (train) or below (validation) that of the other.
        until_train = tt if vc == vt else min(tt, vc * tt // vt + 1)
        until_val = vt if tc == tt else min(vt, -(-tc * vt // tt))
        for name, number in zip(numbers, (tc, tt, vc, vt, max(0, until_train - tc), max(0, until_val - vc))):
            numbers[name][level] = number
    tc, tt, vc, vt, train_first, val_first = (number_of(F.col("level"), of) for of in numbers.values())
    slot = F.col("slot")
    place = slot + tc + vc

    def of_train(p: Column) -> Column:
        """Train places among the first ``p``; the product of two quotas must fit 64 bits."""
        more = F.call_function("div", (p - 1) * tt, F.greatest(tt + vt, F.lit(1)))
        return F.when(p > 0, F.least(tt, more + 1)).otherwise(F.lit(0))

    is_train = F.when(slot <= train_first, True).when(slot <= val_first, False).otherwise(of_train(place) > of_train(place - 1))
    position = F.when((slot <= train_first) | (slot <= val_first), slot).when(
        is_train, of_train(place) - tc).otherwise(place - of_train(place) - vc)
    return F.when(is_train, S.TRAIN).otherwise(S.VAL_IN), position.cast("bigint")


def fill_dual(
    pool: DataFrame,
    train_targets: dict[str, int],
    val_targets: dict[str, int],
    existing_train: DataFrame | None = None,
    existing_val: DataFrame | None = None,
    locked: DataFrame | None = None,
    seed: int = 42,
    stage: str = "1",
    few: bool = False,
    held: tuple[dict[str, int], dict[str, int]] | None = None,
) -> DataFrame:
    """Fill train and validation together, label by label, keeping both at the same fill ratio.

    ``held`` gives the rows of both existing tables by label, where they are known.
    """
    train_held, val_held = held or (
        level_counts(existing_train, list(train_targets)), level_counts(existing_val, list(val_targets)))
    train_need, val_need = needs(train_targets, train_held), needs(val_targets, val_held)
    rooms = {
        S.TRAIN: max(0, sum(train_targets.values()) - sum(train_held.values())),
        S.VAL_IN: max(0, sum(val_targets.values()) - sum(val_held.values())),
    }
    both = {
        level: train_need.get(level, 0) + val_need.get(level, 0)
        for level in {**train_need, **val_need}
    }
    if not both or not any(rooms.values()):
        return _nothing(pool)
    limit = number_of(F.col("level"), both)
    rows = without(
        _keyed(pool.filter(F.col("level").isin(list(both))), seed), locked, existing_train, existing_val
    )
    ranked = _ranker(few)(rows, KEY, ["level"], TIES, limit, rank="slot")
    split, position = places({
        level: (train_held.get(level, 0), train_targets.get(level, 0), val_held.get(level, 0), val_targets.get(level, 0))
        for level in both
    })
    filled = ranked.withColumns({"split": split, "position": position})
    needed = {S.TRAIN: sum(train_need.values()), S.VAL_IN: sum(val_need.values())}
    if any(needed[split] > rooms[split] for split in rooms):
        filled = _capped(filled, rooms)
    return _picked(filled, stage)


def verified(candidates: DataFrame, responses: DataFrame | None) -> DataFrame:
    """Candidates whose answer was generated and matched the gold result.

    ``responses`` has ``question_id, generation_status, execution_match``; none means that the
    candidates have been checked before.
    """
    if responses is None:
        return candidates
    success = (F.col("generation_status") == S.SUCCESS) & F.col("execution_match")
    return candidates.join(responses.filter(success).select("question_id"), "question_id", "left_semi")


def verify_fill_dual(candidates: DataFrame, responses: DataFrame, *args, **kwargs) -> DataFrame:
    """``fill_dual`` from the candidates that pass verification."""
    return fill_dual(verified(candidates, responses), *args, **{"stage": "2", **kwargs})


def verify_fill_single(candidates: DataFrame, responses: DataFrame, *args, **kwargs) -> DataFrame:
    """``fill_single`` from the candidates that pass verification."""
    return fill_single(verified(candidates, responses), *args, **{"stage": "2", **kwargs})


def backfill_dual(
    pool: DataFrame,
    val_need: int,
    train_need: int,
    *used: DataFrame | None,
    seed: int = 42,
    stage: str = "3",
    few: bool = False,
) -> DataFrame:
    """Fill what is missing regardless of labels: validation first, then train."""
    val_need, train_need = max(0, val_need), max(0, train_need)
    if val_need + train_need == 0:
        return _nothing(pool)
    rows = without(_keyed(pool, seed), *used)
    ranked = _ranker(few)(rows, KEY, ties=TIES, limit=val_need + train_need)
    split = F.when(F.col("rank") <= val_need, S.VAL_IN).otherwise(S.TRAIN)
    return _picked(ranked, stage, split)


def backfill_single(
    pool: DataFrame,
    need: int,
    *used: DataFrame | None,
    split: str = S.VAL_OUT,
    seed: int = 42,
    stage: str = "3",
    few: bool = False,
) -> DataFrame:
    """Fill one split regardless of labels."""
    if need <= 0:
        return _nothing(pool)
    rows = without(_keyed(pool, seed), *used)
    return _picked(_ranker(few)(rows, KEY, ties=TIES, limit=need), stage, F.lit(split))


def active_fill_dual(candidates: DataFrame, responses: DataFrame, *args, **kwargs) -> DataFrame:
    """``backfill_dual`` from the candidates that pass verification."""
    return backfill_dual(verified(candidates, responses), *args, **{"stage": "4", **kwargs})


def active_fill_single(candidates: DataFrame, responses: DataFrame, *args, **kwargs) -> DataFrame:
    """``backfill_single`` from the candidates that pass verification."""
    return backfill_single(verified(candidates, responses), *args, **{"stage": "4", **kwargs})


def coverage_budget(target: int, held: int, ratio: float = S.COVERAGE_BUDGET_RATIO) -> int:
    """Rows beyond the target that may still be spent on thinly covered databases."""
    return max(0, int(target * ratio) - max(0, held - target))


def _cover(
    pool: DataFrame,
    filled: DataFrame,
    density: int,
    budget: int,
    used: tuple[DataFrame | None, ...],
    split: str,
    seed: int,
    stage: str,
    databases: int | None = None,
) -> DataFrame:
    """Bring databases up to ``density`` rows, within the budget, in shuffled order."""
    if budget <= 0:
        return _nothing(pool)
    held = filled.groupBy("db_id").agg(F.count(F.lit(1)).alias("_held"))
    dense = held.filter(F.col("_held") >= density)
    rows = without(_keyed(pool.join(dense, "db_id", "left_anti"), seed), *used)
    # The plain limit lets every task keep only a few rows a database before the shuffle.
    by_db = Window.partitionBy("db_id").orderBy(KEY, "question_id", "level")
    first = rows.withColumn("_place", F.row_number().over(by_db)).filter(F.col("_place") <= density)
    thin = first.join(held, "db_id", "left").filter(
        F.col("_place") <= density - F.coalesce("_held", F.lit(0))
    )
    few = databases is not None and databases * density <= BROADCAST_ROWS
    ranked = _ranker(few)(thin.select(*TIES, KEY), KEY, ties=TIES, limit=budget)
    return _picked(ranked, stage, F.lit(split))


def cover_dual(
    candidates: DataFrame,
    responses: DataFrame,
    filled: DataFrame,
    train_target: int,
    train_held: int,
    databases: int,
    locked: DataFrame | None = None,
    seed: int = 42,
    stage: str = "3.1",
) -> DataFrame:
    """Add verified train rows of databases with too few rows in train and validation together."""
    budget = coverage_budget(train_target, train_held)
    density = S.COVERAGE_DENSITY if budget >= databases else 1
    pool = verified(candidates, responses)
    return _cover(pool, filled, density, budget, (locked, filled), S.TRAIN, seed, stage, databases)


def cover_single(
    candidates: DataFrame,
    responses: DataFrame,
    filled: DataFrame,
    target: int,
    held: int,
    locked: DataFrame | None = None,
    split: str = S.VAL_OUT,
    seed: int = 42,
    stage: str = "3.1",
    databases: int | None = None,
) -> DataFrame:
    """Add one verified row for each database that has none yet; their number, if known, eases the plan."""
    pool = verified(candidates, responses)
    budget = coverage_budget(target, held)
    return _cover(pool, filled, 1, budget, (locked, filled), split, seed, stage, databases)
