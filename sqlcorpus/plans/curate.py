"""The curation job: from questions and earlier results to filled splits.

The job decides on ids alone. Questions are triaged once into narrow stored pools; each stage reads
the head of a pool, writes at most a quota of rows, and hands the driver counts by split. Text
columns are fetched at the end, for the chosen rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.labels import classify_sql
from sqlcorpus.operators import fill
from sqlcorpus.operators.quota import quota_frame, split_targets
from sqlcorpus.operators.reports import database_coverage, format_coverage, format_target_vs_filled, target_vs_filled
from sqlcorpus.operators.triage import is_success, merge_result, usable_results
from sqlcorpus.operators.validate import validate_questions
from sqlcorpus.plans.pools import Pool, prepare_domains
from sqlcorpus.plans.waves import AskedPool
from sqlcorpus.session import Workspace
from sqlcorpus.sources.readers import read_curated
from sqlcorpus.sources.writers import append_results, write_curated

PICKED_SCHEMA = "question_id string, db_id string, level string, split string, stage string"
EXISTING = "existing"


@dataclass
class Settings:
    train_size: int = 1000
    val_in_size: int = 150
    val_out_size: int = 150
    domain_ratio: float = 0.8
    seed: int = 42
    shares: dict[str, float] = field(default_factory=lambda: dict(S.LEVEL_SHARES))
    strict_compat: bool = False

    def sizes(self) -> dict[str, int]:
        return {S.TRAIN: self.train_size, S.VAL_IN: self.val_in_size, S.VAL_OUT: self.val_out_size}


class Splits:
    """Rows chosen so far: stored tables of at most a quota of rows each, and their counts."""

    def __init__(
        self, workspace: Workspace, targets: dict[str, dict[str, int]],
        existing: DataFrame | None, locked: DataFrame | None,
    ):
        self.workspace = workspace
        self.targets = targets
        self.locked = locked
        self.counts: dict[str, int] = dict.fromkeys(targets, 0)
        self.held: dict[str, dict[str, int]] = {split: {} for split in targets}
        self.parts: list[DataFrame] = []
        self._locked = 0 if locked is None else locked.count()
        if existing is not None:
            kept = existing.filter(F.col("split").isin(list(targets)))
            self.add(kept.select("question_id", "db_id", "level", "split", F.lit(EXISTING).alias("stage")))

    def add(self, rows: DataFrame) -> None:
        table = self.workspace.table(rows, "_".join(self.targets))
        # Labels without a target only count for the split.
        known = list({level for targets in self.targets.values() for level in targets})
        level = F.when(F.col("level").isin(known), F.col("level")).otherwise(F.lit("")).alias("level")
        for row in table.groupBy("split", level).agg(F.count(F.lit(1)).alias("n")).collect():
            self.counts[row["split"]] += row["n"]
            levels = self.held[row["split"]]
            levels[row["level"]] = levels.get(row["level"], 0) + row["n"]
        self.parts.append(table)

    def rows(self) -> DataFrame:
        if not self.parts:
            return self.workspace.spark.createDataFrame([], PICKED_SCHEMA)
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.union(part)
        return out

    def of(self, split: str) -> DataFrame | None:
        return self.rows().filter(F.col("split") == split) if self.parts else None

    def total(self, split: str) -> int:
        return sum(self.targets[split].values())

    def open(self, split: str) -> int:
        """Places of a split still open, none if it holds more than it should."""
        return max(0, self.total(split) - self.counts[split])

    def is_full(self) -> bool:
        return not any(self.open(split) for split in self.targets)

    def in_use(self) -> int:
        """An upper bound of the rows of a pool that are taken."""
        return self._locked + sum(self.counts.values())

    def by_label(self, pool: Pool | AskedPool) -> tuple[DataFrame, bool]:
        """The head of a pool that can fill every label up to its targets."""
        levels = {level for targets in self.targets.values() for level in targets}
        wanted = {level: sum(targets.get(level, 0) for targets in self.targets.values()) for level in levels}
        if isinstance(pool, AskedPool):
            short = {
                level: sum(max(0, targets.get(level, 0) - self.held[split].get(level, 0))
                           for split, targets in self.targets.items())
                for level in levels
            }
            return pool.ask_labels(short), False
        return pool.head({level: n for level, n in wanted.items() if n}, self.in_use())

    def of_any_label(self, pool: Pool | AskedPool) -> tuple[DataFrame, bool]:
        """The head of a pool that can fill all open places."""
        if isinstance(pool, AskedPool):
            return pool.ask_any(sum(self.open(split) for split in self.targets)), False
        return pool.head_of_all(sum(self.open(split) for split in self.targets), self.in_use())


def curate_in_domain(
    workspace: Workspace,
    success: Pool,
    passed: Pool | AskedPool | None,
    train_targets: dict[str, int],
    val_targets: dict[str, int],
    databases: int,
    existing: DataFrame | None = None,
    locked: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """Train and in-domain validation: cache by label, verified candidates by label, cache
    regardless of label, coverage of databases, verified candidates regardless of label.

    Without ``passed`` candidates the stages that need them add nothing.
    """
    state = Splits(workspace, {S.TRAIN: train_targets, S.VAL_IN: val_targets}, existing, locked)

    def by_label(pool: Pool | AskedPool, stage: str) -> None:
        if not state.is_full():
            head, few = state.by_label(pool)
            state.add(fill.fill_dual(
                head, train_targets, val_targets, state.of(S.TRAIN), state.of(S.VAL_IN), locked, seed, stage, few,
                (state.held[S.TRAIN], state.held[S.VAL_IN]),
            ))

    def any_label(pool: Pool | AskedPool, stage: str) -> None:
        if not state.is_full():
            head, few = state.of_any_label(pool)
            state.add(fill.backfill_dual(
                head, state.open(S.VAL_IN), state.open(S.TRAIN), locked, state.rows(), seed=seed, stage=stage, few=few
            ))

    by_label(success, "1")
    if passed is not None:
        by_label(passed, "2")
    any_label(success, "3")
    if passed is None:
        return state.rows()
    budget = fill.coverage_budget(state.total(S.TRAIN), state.counts[S.TRAIN])
    if budget > 0:
        if isinstance(passed, AskedPool):
            passed.ask_databases(state.rows(), S.COVERAGE_DENSITY if budget >= databases else 1)
        state.add(fill.cover_dual(
            passed.rows, None, state.rows(), state.total(S.TRAIN), state.counts[S.TRAIN], databases, locked, seed
        ))
    any_label(passed, "4")
    return state.rows()


def curate_single(
    workspace: Workspace,
    success: Pool,
    passed: Pool | AskedPool | None,
    targets: dict[str, int],
    databases: int,
    split: str = S.VAL_OUT,
    existing: DataFrame | None = None,
    locked: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """One split through the same stages."""
    state = Splits(workspace, {split: targets}, existing, locked)

    def by_label(pool: Pool | AskedPool, stage: str) -> None:
        if not state.is_full():
            head, few = state.by_label(pool)
            state.add(fill.fill_single(head, targets, split, state.of(split), locked, seed, stage, few, state.held[split]))

    def any_label(pool: Pool | AskedPool, stage: str) -> None:
        if not state.is_full():
            head, few = state.of_any_label(pool)
            state.add(fill.backfill_single(
                head, state.open(split), locked, state.rows(), split=split, seed=seed, stage=stage, few=few
            ))

    by_label(success, "1")
    if passed is not None:
        by_label(passed, "2")
    any_label(success, "3")
    if passed is None:
        return state.rows()
    if fill.coverage_budget(state.total(split), state.counts[split]) > 0:
        if isinstance(passed, AskedPool):
            passed.ask_databases(state.rows(), 1)
        state.add(fill.cover_single(
            passed.rows, None, state.rows(), state.total(split), state.counts[split], locked, split, seed, databases=databases
        ))
    any_label(passed, "4")
    return state.rows()


def curate(
    workspace: Workspace,
    questions: DataFrame,
    results: DataFrame,
    responses: DataFrame | None,
    settings: Settings = Settings(),
    existing: DataFrame | None = None,
    verify: Callable[[DataFrame], DataFrame] | None = None,
    answers: list[AskedPool] | None = None,
) -> DataFrame:
    """Fill all splits: ``question_id, db_id, level, split, stage``.

    ``existing`` holds rows of earlier runs with their split; they stay, and fill their quotas.
    Questions without a label are labelled. Instead of ``responses`` to all candidates there may be a
    function ``verify`` from ``question_id, db_id, level`` to result records: stages then ask for the
    candidates they need, and fill the same rows. ``answers`` collects what was asked.
    """
    if verify is not None:
        # Any candidate may turn out to pass.
        responses = questions.select(
            "question_id", F.lit(S.SUCCESS).alias("generation_status"), F.lit(True).alias("execution_match"))
    labelled = questions
    if "level" not in questions.columns:
        labelled = questions.withColumn("level", classify_sql(F.col("gold_sql")))
    domains = prepare_domains(
        workspace, validate_questions(labelled), results, responses, list(settings.shares),
        settings.domain_ratio, settings.seed,
    )
    targets = split_targets(workspace.spark, settings.sizes(), settings.shares, settings.strict_compat)
    inside, outside = domains[S.IN_DOMAIN], domains[S.OUT_OF_DOMAIN]
    asked = responses is not None
    passed = {name: domain.passed if asked else None for name, domain in domains.items()}
    if verify is not None:
        passed = {
            name: AskedPool(workspace, pool.rows, verify, existing, settings.seed) for name, pool in passed.items()
        }
        if answers is not None:
            answers += passed.values()
    in_domain = curate_in_domain(
        workspace, inside.success, passed[S.IN_DOMAIN], targets[S.TRAIN], targets[S.VAL_IN],
        inside.databases.count(), existing, existing, settings.seed,
    )
    out_of_domain = curate_single(
        workspace, outside.success, passed[S.OUT_OF_DOMAIN], targets[S.VAL_OUT],
        outside.databases.count(), S.VAL_OUT, existing, existing, settings.seed,
    )
    return in_domain.union(out_of_domain)


#: Stages that draw from stored results; the others draw from responses to candidates.
CACHE_STAGES = ("1", "3")


def fetch_curated(
    picked: DataFrame, questions: DataFrame, results: DataFrame, responses: DataFrame | None = None
) -> DataFrame:
    """The full records of chosen questions, with ``split`` and ``stage``.

    A question is stored with a successful record of the side it was picked from, in the fixed order
    of ``first_results``. Chosen ids are few beside the corpus, so sides are cut down to them first.
    """
    from_cache = F.col("stage").isin(*CACHE_STAGES)
    sides = [(results, picked.filter(from_cache))]
    if responses is not None:
        sides.append((responses, picked.filter(~from_cache)))
    found = [
        usable_results(side).filter(is_success()).join(chosen.select("question_id"), "question_id", "left_semi")
        for side, chosen in sides
    ]
    records = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    asked = questions.join(picked.select("question_id"), "question_id", "left_semi")
    return merge_result(asked, records).join(picked.select("question_id", "split", "stage"), "question_id")


def run_curation(
    workspace: Workspace,
    questions: DataFrame,
    results: DataFrame,
    responses: DataFrame | None,
    path: str,
    settings: Settings = Settings(),
    verify: Callable[[DataFrame], DataFrame] | None = None,
    results_path: str | None = None,
) -> str:
    """Curate and store the splits below ``path``, a folder each.

    Rows stored there by earlier runs stay as they are; only new ones are added. ``responses`` holds
    result records of candidates. With ``verify`` instead a model is asked while stages fill, and its
    successful answers are appended to the results at ``results_path``. Returns a report of targets,
    filled rows and covered databases.
    """
    earlier = read_curated(workspace.spark, path).select("question_id", "db_id", "level", "split")
    existing = workspace.table(earlier, EXISTING)
    pools: list[AskedPool] = []
    picked = workspace.table(
        curate(workspace, questions, results, responses, settings, existing, verify, pools), "picked")
    for pool in pools:
        given = pool.responses()
        responses = given if responses is None else responses.unionByName(given, allowMissingColumns=True)
    if pools and results_path:
        append_results(responses, results_path)
    new = picked.filter(F.col("stage") != EXISTING)
    write_curated(fetch_curated(new, questions, results, responses), path, mode="append")
    return curation_report(workspace, picked, questions, settings)


def curation_report(workspace: Workspace, picked: DataFrame, questions: DataFrame, settings: Settings) -> str:
    """Targets beside filled rows, after each stage and at the end, and the coverage of databases, as text."""
    goals = quota_frame(
        workspace.spark, split_targets(workspace.spark, settings.sizes(), settings.shares, settings.strict_compat))
    stages = sorted(row["stage"] for row in picked.select("stage").distinct().collect())
    held = picked.filter(F.col("stage") == EXISTING)
    parts = []
    for stage in [s for s in stages if s != EXISTING]:
        held = held.union(picked.filter(F.col("stage") == stage))
        report = target_vs_filled(held, goals)
        parts += [f"## After stage {stage}", *[format_target_vs_filled(report, split) for split in settings.sizes()]]
    for split in settings.sizes():
        coverage = database_coverage(picked.filter(F.col("split") == split), questions)
        parts.append(format_coverage(coverage, split, workspace.path("coverage")))
    return "\n\n".join(parts)
