"""Session settings, and the shared folder where a job keeps its intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# The most rows of a driver-sized dimension that a plan may broadcast by hint.
BROADCAST_ROWS = 1_000_000


def get_spark(app: str = "sqlcorpus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on; keyword names use ``__`` for a dot."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    """A temporary folder for a session that runs on this machine only."""
    return tempfile.mkdtemp(prefix="sqlcorpus-")


class Workspace:
    """Intermediate tables of one job, written as Parquet below the shared folder.

    Writing a table cuts the plan's lineage, survives the loss of executors, and leaves file
    sizes from which Spark itself decides whether a later join may broadcast the table.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_folder(spark)}/sqlcorpus/{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        """A path of its own for every call."""
        self._count += 1
        return f"{self.root}/{self._count:04d}_{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the tables; call it once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, on any file system Spark can reach, exists."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def folder_names(spark: SparkSession, path: str) -> set[str]:
    """Names of what a folder holds; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return {status.getPath().getName() for status in files.listStatus(target)} if files.exists(target) else set()


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file listings write it, with its scheme and without a closing slash."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")


def first_characters(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, first character that is no white space) of a file, or of every file of a folder; "" if blank.

    A file is read up to that character, however far it is.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(status.getPath().toString() for status in files.listStatus(target) if status.isFile())
    found = []
    for name in names:
        if name.rsplit("/", 1)[-1][0] in "._":
            continue
        stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(name))
        try:
            # Bytes of a byte order mark are beyond ASCII; a line may be as long as the file, so no line is read.
            code = stream.read()
            while code >= 128 or 0 <= code <= 32:
                code = stream.read()
            found.append((name, "" if code < 0 else chr(code)))
        finally:
            stream.close()
    return found
