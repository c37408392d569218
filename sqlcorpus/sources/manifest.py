"""Tables that several jobs append to at once: a list of committed folders, of which only the next version can be made."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sqlcorpus.session import folder_names, qualified

VERSIONS = "_versions"


class Manifest:
    """The folders of a table that count, by version; a folder that no version names was never committed.

    A version is a file that lists all of them. It appears whole, and only if there is none of its number yet, so of
    two jobs that both add to the version they read one has to read again. A plain Parquet folder is a table of
    version 0 with its files as they are.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def latest(self) -> tuple[int, list[str]]:
        """The last version, and its folders or files below the table's path."""
        names = folder_names(self.spark, f"{self.path}/{VERSIONS}")
        numbers = [int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()]
        if not numbers:
            return 0, sorted(n for n in folder_names(self.spark, self.path) if n[0] not in "._" and n.endswith(".parquet"))
        version = max(numbers)
        return version, json.loads(self.spark.read.text(self._file(version), wholetext=True).first()[0])

    def read(self, schema: StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for name in folders])

    def commit(self, version: int, folders: list[str]) -> bool:
        """Make ``version`` of these folders; false if another job has made it."""
        text, target = json.dumps(folders), self._file(version)
        own = f"{self.path}/{VERSIONS}/.{version:08d}-{os.urandom(8).hex()}"
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        hadoop = jvm.org.apache.hadoop.fs
        files = hadoop.Path(own).getFileSystem(conf)
        stream = files.create(hadoop.Path(own), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        place = qualified(self.spark, target)
        if place.startswith("file:"):
            # A link is made only if its name is free; the local file system's rename does not say.
            try:
                os.link(qualified(self.spark, own).removeprefix("file:"), place.removeprefix("file:"))
                return True
            except FileExistsError:
                return False
            finally:
                files.delete(hadoop.Path(own), False)
        # A rename in the store either makes the name or finds it taken.
        made = not files.exists(hadoop.Path(target)) and files.rename(hadoop.Path(own), hadoop.Path(target))
        if not made:
            files.delete(hadoop.Path(own), False)
        return made

    def _file(self, version: int) -> str:
        return f"{self.path}/{VERSIONS}/{version:08d}.json"
