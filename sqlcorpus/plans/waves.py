"""Fill quotas from a model that is asked only for as many candidates as may be needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.keys import shuffle_key
from sqlcorpus.operators import fill
from sqlcorpus.operators.quota import small_frame
from sqlcorpus.operators.ranking import rank_by_key
from sqlcorpus.operators.triage import is_success
from sqlcorpus.session import Workspace


def verify_in_waves(
    workspace: Workspace,
    candidates: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    need: dict[str, int] | DataFrame,
    seed: int = 42,
    oversample: float = 1.5,
    max_waves: int = 20,
    group: Column | None = None,
) -> DataFrame:
    """Responses to candidates, in shuffled order group by group, until every need is met.

    ``verify`` takes ``question_id, db_id, level`` and returns stored-result rows. Groups are labels, or the values of
    the column ``group``; ``need`` gives the passed candidates wanted of each, as a mapping or, for any number of
    groups, as a table ``group_name, need``. Each wave takes the next ranks of the groups still short, and grows where
    a wave brought too little; the last takes all that is left. A fill from the result takes the same rows as one
    from responses to all candidates, for any wave size. What is asked and passed stays a stored table with a row a
    group; the driver only hears whether a group is still short. ``candidates`` should be a stored table, as every
    wave reads it.
    """
    spark = workspace.spark
    if not isinstance(need, DataFrame):
        if not need:
            return spark.createDataFrame([], S.RESULTS)
        need = small_frame(spark, list(need.items()), "group_name string, need bigint")
    keyed = candidates.select(
        (F.col("level") if group is None else group).cast("string").alias("group_name"), *fill.TIES,
        shuffle_key(F.col("question_id"), seed).alias(fill.KEY))
    sizes = keyed.groupBy("group_name").agg(F.count(F.lit(1)).alias("size"))
    state = workspace.table(need.join(sizes, "group_name").select(
        "group_name", F.col("need").cast("bigint"), "size", F.lit(0).cast("bigint").alias("asked"),
        F.lit(0).cast("bigint").alias("done")), "needs")
    waves: list[DataFrame] = []
    for wave in range(max_waves):
        more = F.ceil((F.col("need") - F.col("done")) * oversample * 2**wave)
        upto = F.col("size") if wave == max_waves - 1 else F.least("size", F.col("asked") + more)
        short = state.filter("done < need AND asked < size").withColumn("upto", upto)
        if not short.take(1):
            break
        ranked = rank_by_key(keyed, fill.KEY, ["group_name"], fill.TIES, between=short.select(
            "group_name", (F.col("asked") + 1).alias("first"), F.col("upto").alias("last")))
        chosen = workspace.table(ranked.select("group_name", *fill.TIES), f"wave_{wave}")
        answers = workspace.table(verify(chosen.select(*fill.TIES)), f"answers_{wave}")
        waves.append(answers)
        success = answers.filter((F.col("generation_status") == S.SUCCESS) & F.col("execution_match"))
        passed = chosen.join(success.select("question_id"), "question_id", "left_semi").groupBy("group_name").agg(
            F.count(F.lit(1)).alias("_passed"))
        state = workspace.table(
            state.join(short.select("group_name", "upto"), "group_name", "left").join(passed, "group_name", "left").select(
                "group_name", "need", "size", F.coalesce("upto", "asked").alias("asked"),
                (F.col("done") + F.coalesce("_passed", F.lit(0))).alias("done")), "needs")
    if not waves:
        return spark.createDataFrame([], S.RESULTS)
    out = waves[0]
    for answers in waves[1:]:
        out = out.unionByName(answers)
    return out


class AskedPool:
    """Verified candidates of a domain, asked for only as far as a stage needs them.

    Each request asks in shuffled order until enough new candidates have passed, or none is left. All
    candidates before the last one asked are then known, so a stage takes the rows it would take if
    every candidate had been asked. Any number of databases may be asked for at once.
    """

    def __init__(
        self, workspace: Workspace, candidates: DataFrame, verify: Callable[[DataFrame], DataFrame],
        locked: DataFrame | None = None, seed: int = 42,
    ):
        self.workspace, self.verify, self.seed = workspace, verify, seed
        self.left = workspace.table(fill.without(candidates.select(*fill.TIES), locked), "candidates")
        self.answers: list[DataFrame] = []
        self.rows = workspace.table(self.left.limit(0), "passed")

    def _ask(self, group: Column, need: dict[str, int] | DataFrame) -> None:
        if isinstance(need, dict):
            need = {name: n for name, n in need.items() if n > 0}
            if not need:
                return
        found = self.workspace.table(
            verify_in_waves(self.workspace, self.left, self.verify, need, self.seed, group=group), "answers")
        self.answers.append(found)
        passed = found.filter(is_success()).select("question_id")
        self.rows = self.workspace.table(
            self.rows.unionByName(self.left.join(passed, "question_id", "left_semi")), "passed")
        self.left = self.workspace.table(self.left.join(found.select("question_id"), "question_id", "left_anti"), "left")

    def ask_labels(self, need: dict[str, int]) -> DataFrame:
        self._ask(F.col("level"), need)
        return self.rows

    def ask_any(self, need: int) -> DataFrame:
        self._ask(F.lit("any"), {"any": need})
        return self.rows

    def ask_databases(self, filled: DataFrame, density: int) -> DataFrame:
        """Until every database with fewer than ``density`` filled rows could get there."""
        held = filled.groupBy("db_id").agg(F.count(F.lit(1)).alias("_held"))
        need = self.left.select("db_id").distinct().join(held, "db_id", "left").select(
            F.col("db_id").alias("group_name"), (F.lit(density) - F.coalesce("_held", F.lit(0))).alias("need"))
        self._ask(F.col("db_id"), self.workspace.table(need.filter("need > 0"), "thin"))
        return self.rows

    def responses(self) -> DataFrame:
        """All answers so far."""
        out = self.workspace.spark.createDataFrame([], S.RESULTS)
        for part in self.answers:
            out = out.unionByName(part, allowMissingColumns=True)
        return out
