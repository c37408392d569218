"""First rows of many Parquet tables of their own shapes, each read by the task that holds its name."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pa_fs
from pyspark.sql.pandas.types import from_arrow_type

#: A cell on its way to text: real numbers and instants as such, as Spark writes them out; all others as text.
HEADS = ("db_id string, table_name string, row_no int, header array<string>, "
         "cells array<struct<text:string,real:double,micros:long>>")
CELL = pa.struct([("text", pa.string()), ("real", pa.float64()), ("micros", pa.int64())])
SCHEMA = pa.schema([("db_id", pa.string()), ("table_name", pa.string()), ("row_no", pa.int32()),
                    ("header", pa.list_(pa.string())), ("cells", pa.list_(CELL))])
SHAPES = "db_id string, table_name string, names array<string>, kinds array<string>"
SHAPE_SCHEMA = pa.schema([("db_id", pa.string()), ("table_name", pa.string()), ("names", pa.list_(pa.string())),
                          ("kinds", pa.list_(pa.string()))])
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def open_files(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path on it: local, or by its address."""
    local = path.removeprefix("file:")
    if local.startswith("/"):
        return pa_fs.LocalFileSystem(), "/" + local.lstrip("/")
    return pa_fs.FileSystem.from_uri(path)


def data_files(files: pa_fs.FileSystem, path: str) -> list[str]:
    """The files of a table in the order of their names; a file is a table of one."""
    if files.get_file_info(path).type == pa_fs.FileType.File:
        return [path]
    found = files.get_file_info(pa_fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == pa_fs.FileType.File and f.base_name[0] not in "._")


def nested_text(value) -> str:
    """A value inside of a nested one, in the notation of Spark."""
    if value is None:
        return "null"
    if isinstance(value, dict):
        return "{" + ", ".join(map(nested_text, value.values())) + "}"
    if isinstance(value, list):
        if value and all(isinstance(v, tuple) for v in value):
            return "{" + ", ".join(f"{nested_text(k)} -> {nested_text(v)}" for k, v in value) + "}"
        return "[" + ", ".join(map(nested_text, value)) + "]"
    return str(value).lower() if isinstance(value, bool) else str(value)


def cell(value, kind: pa.DataType, instant: bool) -> dict:
    out = {"text": None, "real": None, "micros": None}
    if value is None:
        return out
    if pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        out["real"] = float(value)
    elif pa.types.is_boolean(kind):
        out["text"] = str(int(value))
    elif pa.types.is_timestamp(kind) and instant:
        if value.tzinfo is None:
            value = value.replace(tzinfo=datetime.timezone.utc)
        out["micros"] = (value - EPOCH) // datetime.timedelta(microseconds=1)
    elif pa.types.is_timestamp(kind):
        text = value.isoformat(" ")
        out["text"] = text.rstrip("0") if "." in text else text
    else:
        out["text"] = nested_text(value) if pa.types.is_nested(kind) else str(value)
    return out


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``SHAPES`` rows of the tables named by ``db_id, table_name, path``, from a footer of each; a table that cannot
    be read is left out."""
    for batch in batches:
        for db_id, table_name, path in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                files, base = open_files(path)
                with files.open_input_file(data_files(files, base)[0]) as stream:
                    schema = pq.read_schema(stream)
            except (pa.ArrowInvalid, OSError, IndexError):
                continue
            kinds = [from_arrow_type(f.type).simpleString().upper() for f in schema]
            yield pa.RecordBatch.from_pydict({
                "db_id": [db_id], "table_name": [table_name], "names": [schema.names], "kinds": [kinds]}, schema=SHAPE_SCHEMA)


def head(path: str, n: int) -> tuple[list[str], list[list[dict]]]:
    """(names, rows of cells): the first ``n`` rows of a table in file order, without its binary columns.

    Only as many row groups are read as hold these rows, and only their columns. Names come from the first file.
    """
    files, base = open_files(path)
    names, kinds, rows = None, {}, []
    for name in data_files(files, base):
        with files.open_input_file(name) as stream:
            table = pq.ParquetFile(stream)
            own = {f.name: f.type for f in table.schema_arrow}
            if names is None:
                plain = [(c, t) for c, t in own.items() if not pa.types.is_binary(t) and not pa.types.is_large_binary(t)]
                names, kinds = [c for c, _ in plain], dict(plain)
            physical = {table.schema.column(i).path: table.schema.column(i).physical_type for i in range(len(table.schema))}
            instant = {c: getattr(kinds[c], "tz", None) is not None or physical.get(c) == "INT96" for c in names}
            for batch in table.iter_batches(max(n - len(rows), 1), columns=[c for c in names if c in own]):
                held = {c: batch.column(c).cast(pa.timestamp("us", kinds[c].tz), safe=False).to_pylist()
                        if pa.types.is_timestamp(batch.schema.field(c).type) else batch.column(c).to_pylist()
                        for c in batch.schema.names}
                empty = [None] * batch.num_rows
                for values in zip(*(held.get(c, empty) for c in names)) if names else ():
                    rows.append([cell(v, kinds[c], instant[c]) for v, c in zip(values, names)])
                if len(rows) >= n:
                    return names, rows[:n]
    if names is None:
        raise FileNotFoundError(path)
    return names, rows[:n]


def read_heads(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """``HEADS`` rows of the tables named by ``db_id, table_name, path``; a table that cannot be read is left out."""
    for batch in batches:
        for db_id, table_name, path in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                names, rows = head(path, n)
            except (pa.ArrowInvalid, OSError):
                continue
            if rows:
                count = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([db_id] * count, pa.string()), pa.array([table_name] * count, pa.string()),
                    pa.array(range(1, count + 1), pa.int32()), pa.array([names] * count, pa.list_(pa.string())),
                    pa.array(rows, pa.list_(CELL))], schema=SCHEMA)
