"""Run pairs of SQL statements on Spark and keep their results as rows to compare."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from threading import Event, Timer

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions.tables import dedupe_columns
from sqlcorpus.functions.text import clean_sql
from sqlcorpus.operators.compare import GOLD, PRED, result_rows
from sqlcorpus.session import Workspace

# Functions that run code of the machine rather than query it.
CALLS_OUT = re.compile(r"\b(?:try_)?reflect[`\s]*\(|\bjava_method[`\s]*\(", re.IGNORECASE)

# Names in double quotes are names, as the library's own DDL writes them, and tables are only those registered.
SESSION = {
    "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
}

STATUS = "statement_id string, ok boolean, cols array<string>, error_msg string"


def distinct_statements(pairs: DataFrame) -> DataFrame:
    """``statement_id, db_id, sql``: each cleaned statement of a database once.

    ``pairs`` has ``pair_id, db_id, gold_sql, predicted_sql``.
    """
    both = pairs.select("db_id", clean_sql(F.col("gold_sql")).alias("sql")).union(
        pairs.select("db_id", clean_sql(F.col("predicted_sql")).alias("sql"))
    )
    return both.distinct().select(_statement_id().alias("statement_id"), "db_id", "sql")


def _statement_id():
    return F.sha2(F.concat("db_id", F.lit("\n"), "sql"), 256)


def _run(session: SparkSession, statement, path: str, timeout: float) -> tuple:
    """Run one statement and write its rows below ``path``; a failure is a result, too."""
    if not statement["sql"]:
        return statement["statement_id"], False, None, "empty statement"
    group = uuid.uuid4().hex
    context = session.sparkContext
    context.setJobGroup(group, "statement", interruptOnCancel=True)
    late = Event()

    def cancel() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = Timer(timeout, cancel)
    timer.start()
    try:
        if CALLS_OUT.search(statement["sql"]):
            raise PermissionError("statements may not call methods by reflection")
        # As a subquery, nothing but a query is accepted.
        df = session.sql(f"SELECT * FROM (\n{statement['sql']}\n)")
        names = df.columns
        cells = [f"c{i}" for i in range(len(names))]
        rows = result_rows(df.toDF(*cells), F.lit(""), "", cells).select("row")
        # A folder of its own, as jobs that write at the same time must not share one.
        rows.write.mode("overwrite").parquet(f"{path}/statement_id={statement['statement_id']}")
        return statement["statement_id"], True, names, None
    except Exception as error:
        text = re.split(r"\n*JVM stacktrace", str(error), maxsplit=1)[0]
        if late.is_set():
            text = f"timed out after {timeout:g} seconds"
        return statement["statement_id"], False, None, text or type(error).__name__
    finally:
        timer.cancel()


def execute_pairs(
    pairs: DataFrame,
    register: Callable[[SparkSession, str], None],
    workspace: Workspace,
    threads: int = 8,
    timeout: float = S.QUERY_TIMEOUT_SEC,
    batch: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """``result_rows`` and ``executions`` of statement pairs, as ``compare_results`` takes them.

    ``register(session, db_id)`` makes the tables of a database known to a session. Statements are
    run once each, several at a time, every one a Spark job of its own whose rows are written where
    they are computed. The driver only sees statements, a batch at a time, and their outcomes.
    """
    spark = pairs.sparkSession
    statements = workspace.table(distinct_statements(pairs).orderBy("db_id"), "statements")
    rows_path, status_path = workspace.path("statement_rows"), workspace.path("status")
    spark.createDataFrame([], "row array<string>").write.parquet(f"{rows_path}/statement_id=none")
    sessions: dict[str, SparkSession] = {}

    def session_of(db_id: str) -> SparkSession:
        if db_id not in sessions:
            sessions[db_id] = spark.newSession()
            for name, value in SESSION.items():
                sessions[db_id].conf.set(name, value)
            register(sessions[db_id], db_id)
        return sessions[db_id]

    todo = statements.toLocalIterator(prefetchPartitions=True)
    with ThreadPoolExecutor(threads) as pool:
        while chunk := list(islice(todo, batch)):
            wanted = {row["db_id"] for row in chunk}
            for db_id in set(sessions) - wanted:
                del sessions[db_id]
            ready = [(session_of(row["db_id"]), row) for row in chunk]
            done = list(pool.map(lambda job: _run(job[0], job[1], rows_path, timeout), ready))
            spark.createDataFrame(done, STATUS).coalesce(1).write.mode("append").parquet(status_path)
    status = spark.read.schema(STATUS).parquet(status_path).withColumn("cols", dedupe_columns(F.col("cols")))
    ran = spark.read.schema("row array<string>, statement_id string").parquet(rows_path)
    return _by_pair(pairs, status, ran)


def _by_pair(pairs: DataFrame, status: DataFrame, ran: DataFrame) -> tuple[DataFrame, DataFrame]:
    def ids(column: str, side: str) -> DataFrame:
        named = pairs.select("pair_id", "db_id", clean_sql(F.col(column)).alias("sql"))
        return named.select("pair_id", _statement_id().alias("statement_id"), F.lit(side).alias("side"))

    sides = ids("gold_sql", GOLD).union(ids("predicted_sql", PRED))
    ok = status.filter("ok").select("statement_id")
    rows = sides.join(ran.join(ok, "statement_id", "left_semi"), "statement_id")
    rows = rows.select("pair_id", "side", "row")
    known = sides.join(status, "statement_id")

    def of(side: str, column: str):
        return F.first(F.when(F.col("side") == side, F.col(column)), ignorenulls=True)

    executions = known.groupBy("pair_id").agg(
        of(GOLD, "ok").alias("gold_ok"), of(PRED, "ok").alias("pred_ok"),
        of(GOLD, "cols").alias("gold_cols"), of(PRED, "cols").alias("pred_cols"),
        of(PRED, "error_msg").alias("error_msg"),
    )
    return rows, executions
