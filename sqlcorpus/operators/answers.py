"""Answers of a model that are kept as they come, so that no prompt is paid for twice.

A log is a folder that the driver and all executors can open. A task writes each batch of answers into pieces of its
own before it asks on; a task that is started again, and a later run, read the pieces first. When a run ends, its
answers are one Parquet table of the log, written by Spark, and its pieces go.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus import schemas as S
from sqlcorpus.operators.generate import Generator, ask_batch, with_retry
from sqlcorpus.session import path_exists, qualified
from sqlcorpus.sources.heads import open_files

#: Rows of a finished run. Only answered ones count later; the others may be asked again.
ANSWERED = "digest string, raw_content string, generation_status string, error_message string"
PIECE = "digest string, raw_content string"
#: Seconds between two looks at the pieces of another attempt of the same task.
REFRESH = 5.0
#: Answers that a task hands to Spark at once, at least, unless its rows end; they are in a piece before.
HANDED = 1000


def prompt_digest(prompt: str = "prompt"):
    return F.sha2(F.col(prompt).cast("binary"), 256)


class Pieces:
    """Batches of answers below a folder, as a task writes and finds them.

    On a mount an attempt has one file and adds each batch to its end, so there are as many files as attempts, however
    small the batches; a line that was cut when the attempt died does not count. An object store takes no additions: a
    batch is a file there and appears whole, as it is moved to its name when it is closed.
    """

    def __init__(self, root: str, task: int) -> None:
        self.files, base = open_files(root)
        self.folder = f"{base}/task={task:06d}"
        self.answers: dict[str, str] = {}
        self._read: dict[str, int | None] = {}  # bytes taken in, by file; None: written here
        self._looked = -REFRESH
        self._grows = isinstance(self.files, pa_fs.LocalFileSystem)
        self._own = None

    def refresh(self) -> None:
        """Take in the pieces that any attempt of this task has written, if some seconds have gone by since."""
        if time.monotonic() - self._looked < REFRESH:
            return
        self._looked = time.monotonic()
        found = self.files.get_file_info(pa_fs.FileSelector(self.folder, allow_not_found=True))
        for info in sorted((info for info in found if info.path.endswith(".json")), key=lambda info: info.path):
            done = self._read.get(info.path, 0)
            if done is None or info.size <= done:
                continue
            with self.files.open_input_file(info.path) as file:
                file.seek(done)
                whole = file.read()
            whole = whole[:whole.rfind(b"\n") + 1]
            for line in whole.decode().splitlines():
                row = json.loads(line)
                self.answers.setdefault(row["digest"], row["raw_content"])
            self._read[info.path] = done + len(whole)

    def write(self, rows: list[tuple[str, str]]) -> None:
        if not rows:
            return
        lines = "".join(json.dumps({"digest": d, "raw_content": a}) + "\n" for d, a in rows).encode()
        if self._own is None:
            self.files.create_dir(self.folder, recursive=True)
        name = f"{self.folder}/{len(self._read):06d}-{uuid.uuid4().hex}"
        if self._grows:
            if self._own is None:
                self._own = self.files.open_output_stream(f"{name}.json")
                self._read[f"{name}.json"] = None
            self._own.write(lines)
            self._own.flush()
        else:
            with self.files.open_output_stream(f"{name}.part") as stream:
                stream.write(lines)
            self.files.move(f"{name}.part", f"{name}.json")
            self._read[f"{name}.json"] = None
        self.answers.update(rows)

    def close(self) -> None:
        if self._own is not None:
            self._own.close()
            self._own = None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["digest", "raw_content", "generation_status", "error_message"], dtype=object)


def ask_logged(
    frames: Iterator[pd.DataFrame], make: Callable[[], Generator], pieces: Pieces, batch_size: int, attempts: int,
    delay: float, needs_sql: bool,
) -> Iterator[pd.DataFrame]:
    """Answer ``digest, prompt`` rows in batches; what a piece answers is not asked."""
    fn, found = None, []
    for frame in frames:
        digests, prompts = frame["digest"].tolist(), frame["prompt"].tolist()
        for start in range(0, len(digests), batch_size):
            batch = range(start, min(start + batch_size, len(digests)))
            pieces.refresh()
            asked = [i for i in batch if digests[i] not in pieces.answers]
            rows = []
            if asked:
                fn = fn or with_retry(make(), attempts, delay)
                rows = ask_batch(fn, [digests[i] for i in asked], [prompts[i] for i in asked], attempts, needs_sql)
                pieces.write([(d, answer) for d, answer, status, _ in rows if status == S.SUCCESS and answer is not None])
            open_ones = {digests[i] for i in asked}
            rows += [(digests[i], pieces.answers[digests[i]], S.SUCCESS, None) for i in batch if digests[i] not in open_ones]
            found += rows
            if len(found) >= HANDED:
                yield _frame(found)
                found = []
    if found:
        yield _frame(found)
    pieces.close()


class AnswerLog:
    """The answers below ``path``, by digest of the prompt.

    ``path`` is on a file system that pyarrow opens by its address: a shared mount or an object store.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def known(self) -> DataFrame:
        """``digest, raw_content``: one answer a digest, the smallest text if there are several."""
        parts = []
        if path_exists(self.spark, f"{self.path}/runs"):
            runs = self.spark.read.schema(ANSWERED).option("recursiveFileLookup", "true").parquet(f"{self.path}/runs")
            parts.append(runs.filter(F.col("generation_status") == S.SUCCESS).select("digest", "raw_content"))
        if path_exists(self.spark, f"{self.path}/pieces"):
            parts.append(self.spark.read.schema(PIECE).option("recursiveFileLookup", "true").option(
                "pathGlobFilter", "*.json").json(f"{self.path}/pieces").dropna())  # a cut line has no answer
        if not parts:
            return self.spark.createDataFrame([], PIECE)
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return every.groupBy("digest").agg(F.min("raw_content").alias("raw_content"))

    def generate(
        self,
        df: DataFrame,
        make: Callable[[], Generator],
        batch_size: int = 16,
        attempts: int = S.RETRY_ATTEMPTS,
        delay: float = S.RETRY_BASE_DELAY_SEC,
        tasks: int | None = None,
        needs_sql: bool = False,
    ) -> DataFrame:
        """``operators.generate.generate`` through the log: rows as it returns them, from a stored table.

        Each distinct prompt without a logged answer is asked once, however many questions share it, and the answers
        to them are stored before this returns. Prompts are dealt out by digest, so a task that is started again, by
        Spark or by a later run with as many tasks, finds its pieces; pieces of other runs are read by ``known``. If the
        job dies, what it was told stays: at most the batch under way in each task is asked again. Errors are not
        kept, so a later run asks those prompts again.
        """
        run = uuid.uuid4().hex
        pieces = f"{qualified(self.spark, self.path)}/pieces/run={run}"
        stored = f"{self.path}/runs/{run}"
        sent = df.select(F.col("question_id").cast("string").alias("question_id"), "prompt").withColumn(
            "digest", prompt_digest())
        known = self.known()
        distinct = sent.filter(F.col("prompt").isNotNull()).groupBy("digest").agg(F.first("prompt").alias("prompt"))
        wanted = known.join(distinct.select("digest"), "digest", "left_semi")
        tasks = tasks or self.spark.sparkContext.defaultParallelism
        asked = distinct.join(wanted, "digest", "left_anti").repartition(tasks, "digest")

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Pieces(pieces, TaskContext.get().partitionId())
            return ask_logged(frames, make, own, batch_size, attempts, delay, needs_sql)

        told = wanted.select("digest", "raw_content", F.lit(S.SUCCESS).alias("generation_status"),
                             F.lit(None).cast("string").alias("error_message"))
        asked.mapInPandas(work, ANSWERED).unionByName(told).write.parquet(stored)
        self._drop(f"{self.path}/pieces/run={run}")
        answers = self.spark.read.schema(ANSWERED).parquet(stored)
        return sent.join(answers, "digest", "left").select(
            "question_id", "raw_content", F.coalesce("generation_status", F.lit(S.ERROR)).alias("generation_status"),
            F.when(F.col("digest").isNull(), S.CONTEXT_EXCEEDED).otherwise(F.col("error_message")).alias("error_message"))

    def _drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
