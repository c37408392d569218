"""Stored pools: questions to draw from, laid out so that a stage reads only their head.

A stage takes the first rows of a pool in shuffled order. A file of a pool therefore holds one range of
the sampling key, in order, and the driver keeps a count for each label and key bucket, and the file of the
bucket: at most labels times ``16 ** BUCKET_DIGITS`` entries. From them follows a key below which the wanted
rows must lie; files beyond it are not opened, and Parquet skips the row groups beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.keys import shuffle_key
from sqlcorpus.operators.fill import KEY
from sqlcorpus.operators.ranking import BUCKET_DIGITS
from sqlcorpus.operators.triage import bounded_broadcast, split_domains, triage
from sqlcorpus.session import Workspace

SUCCESS_POOL, PASSED_POOL = "success", "passed"
POOL_SCHEMA = f"question_id string, db_id string, level string, {KEY} string, domain string, state string"
OTHER_LABELS = ""
# The most narrow rows that one task ranks.
FEW_ROWS = 1_000_000


@dataclass
class Pool:
    """``question_id, db_id, level`` and the key, with rows by label and key bucket."""

    rows: DataFrame
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    #: The first key bucket of each file.
    files: dict[str, str] = field(default_factory=dict)

    def _below(self, cut: str | None) -> DataFrame:
        """The files that hold keys below ``cut``."""
        if cut is None or not self.files:
            return self.rows
        wanted = [path for path, bucket in self.files.items() if bucket < cut]
        return self.rows.sparkSession.read.schema(self.rows.schema).parquet(*wanted) if wanted else self.rows.limit(0)

    def _cut(self, buckets: dict[str, int], wanted: int) -> tuple[str | None, int]:
        """The key below which the first ``wanted`` rows lie, none if all are needed, and the rows below it."""
        found = 0
        for bucket in sorted(buckets):
            found += buckets[bucket]
            after = int(bucket, 16) + 1
            if found >= wanted and after < 16**BUCKET_DIGITS:
                return format(after, f"0{BUCKET_DIGITS}x"), found
        return None, found

    def head(self, wanted: dict[str, int], slack: int) -> tuple[DataFrame, bool]:
        """At least the first rows wanted of each label, ``slack`` of which may be in use already; and
        whether that is little enough to rank in one task a label."""
        kept, most, cuts = F.lit(False), 0, []
        for level, n in wanted.items():
            cut, size = self._cut(self.counts.get(level, {}), n + slack)
            cuts.append(cut)
            mine = F.col("level") == level
            kept = kept | (mine if cut is None else mine & (F.col(KEY) < cut))
            most = max(most, size)
        last = None if None in cuts else max(cuts, default="")
        return self._below(last).filter(kept), most <= FEW_ROWS

    def head_of_all(self, wanted: int, slack: int) -> tuple[DataFrame, bool]:
        """At least the first ``wanted`` rows regardless of label, and whether one task can rank them."""
        every: dict[str, int] = {}
        for buckets in self.counts.values():
            for bucket, n in buckets.items():
                every[bucket] = every.get(bucket, 0) + n
        cut, size = self._cut(every, wanted + slack)
        return self.rows if cut is None else self._below(cut).filter(F.col(KEY) < cut), size <= FEW_ROWS


def store_pools(workspace: Workspace, rows: DataFrame, levels: list[str], seed: int) -> dict[tuple[str, str], Pool]:
    """Store ``question_id, db_id, level, domain, state`` as a pool for each domain and state."""
    path = workspace.path("pools")
    keyed = rows.select(
        "question_id", "db_id", "level", shuffle_key(F.col("question_id"), seed).alias(KEY), "domain", "state"
    )
    # Keys are even, so even ranges of their prefixes make even files, without sampling the rows.
    bucket = F.substring(KEY, 1, BUCKET_DIGITS)
    parts = int(workspace.spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.call_function("div", F.conv(bucket, 16, 10).cast("bigint") * parts, F.lit(16**BUCKET_DIGITS)).cast("int")
    laid_out = keyed.repartitionById(parts, part).sortWithinPartitions("domain", "state", KEY)
    laid_out.write.partitionBy("domain", "state").parquet(path)
    stored = workspace.spark.read.schema(POOL_SCHEMA).parquet(path)
    level = F.when(F.col("level").isin(levels), F.col("level")).otherwise(OTHER_LABELS)
    counted = stored.groupBy(
        "domain", "state", level.alias("level"), bucket.alias("bucket"), F.col("_metadata.file_path").alias("file")).count()
    pools = {}
    for domain in (S.IN_DOMAIN, S.OUT_OF_DOMAIN):
        for state in (SUCCESS_POOL, PASSED_POOL):
            own = stored.filter((F.col("domain") == domain) & (F.col("state") == state))
            pools[domain, state] = Pool(own.drop("domain", "state"))
    for row in counted.collect():
        pool = pools[row["domain"], row["state"]]
        buckets, file = pool.counts.setdefault(row["level"], {}), unquote(row["file"])
        buckets[row["bucket"]] = buckets.get(row["bucket"], 0) + row["count"]
        pool.files[file] = min(row["bucket"], pool.files.get(file, row["bucket"]))
    return pools


@dataclass
class Domain:
    """What one domain has to draw from."""

    success: Pool
    passed: Pool
    databases: DataFrame


def prepare_domains(
    workspace: Workspace,
    questions: DataFrame,
    results: DataFrame,
    responses: DataFrame | None,
    levels: list[str],
    domain_ratio: float = 0.8,
    seed: int = 42,
) -> dict[str, Domain]:
    """Triage the corpus, check candidates against their responses, and divide both by domain.

    Questions, results and responses meet on the question id, in narrow rows. ``questions`` must be
    valid; ``responses`` has ``question_id, generation_status, execution_match``.
    """
    domains = workspace.table(split_domains(questions.select("db_id"), domain_ratio, seed), "domains")
    triaged = triage(questions, results)
    success, candidate = (F.col("cache_state") == state for state in (S.CACHE_SUCCESS, S.CACHE_CANDIDATE))
    if responses is None:
        drawn = triaged.filter(success).withColumn("state", F.lit(SUCCESS_POOL))
    else:
        good = (F.col("generation_status") == S.SUCCESS) & F.col("execution_match")
        passed = responses.filter(good).groupBy("question_id").agg(F.lit(True).alias("_passed"))
        joined = triaged.filter(success | candidate).join(passed, "question_id", "left")
        drawn = joined.filter(success | F.col("_passed")).withColumn(
            "state", F.when(success, SUCCESS_POOL).otherwise(PASSED_POOL)
        )
    placed = drawn.join(bounded_broadcast(domains), "db_id")
    pools = store_pools(workspace, placed, levels, seed)
    return {
        domain: Domain(
            pools[domain, SUCCESS_POOL],
            pools[domain, PASSED_POOL],
            domains.filter(F.col("domain") == domain).select("db_id"),
        )
        for domain in (S.IN_DOMAIN, S.OUT_OF_DOMAIN)
    }
