"""What the operators share: tables and small batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task turns into Python objects at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """``make()`` runs once a task and gives the function from a small batch to the columns of ``schema``; the batch's
    columns are known by their places."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                out = work(batch.slice(start, SLICE))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in
                     ((out[f.name], f) for f in arrow)], schema=arrow)

    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def keep_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """The rows, with all their columns, for which the function that ``make()`` gives is true of ``columns``."""
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                asked = pa.RecordBatch.from_arrays([part.column(i) for i in places], names=columns)
                yield part.filter(pa.array(work(asked), pa.bool_()))

    # A name may hold a dot, so columns are named by their places meanwhile.
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
