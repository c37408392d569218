"""Cell values as text: a canonical form for comparison, a readable form for prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def canonical_cell(cell: Column, kind: T.DataType) -> Column:
    """A typed text for equality across queries: 1 equals 1.0 and true, but not the text '1'."""
    if isinstance(kind, T.BooleanType):
        value, tag = cell.cast("int").cast("string"), "n"
    elif isinstance(kind, _WHOLE):
        value, tag = cell.cast("string"), "n"
    elif isinstance(kind, T.DecimalType):
        # Digits as they are; trailing zeros after the point are no difference.
        plain = F.regexp_replace(cell.cast("string"), r"(\.\d*?)0+$", "$1")
        plain = F.regexp_replace(plain, r"\.$", "")
        small = (F.abs(cell) < F.lit(1e-3)) & (cell != 0)
        zero = F.when(cell == 0, "0").otherwise(plain)
        value, tag = F.when(small, cell.cast("double").cast("string")).otherwise(zero), "n"
    elif isinstance(kind, _REAL):
        real = cell.cast("double")
        whole = (real == F.floor(real).cast("double")) & (F.abs(real) < F.lit(1e18))
        large = (F.abs(real) >= F.lit(1e7)) & (F.abs(real) < F.lit(1e37))
        digits = F.regexp_replace(real.cast("string").try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
        wide = F.when(F.abs(real) >= F.lit(1e17), real.try_cast("decimal(38,0)").cast("string")).otherwise(digits)
        value, tag = F.when(whole, real.cast("bigint").cast("string")).when(
            large & wide.isNotNull(), wide).otherwise(real.cast("string")), "n"
    elif isinstance(kind, T.BinaryType):
        value, tag = F.hex(cell), "b"
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        value, tag = F.to_json(cell), "j"
    else:
        value, tag = cell.cast("string"), "t"
    return F.concat(F.lit(f"{tag}:"), value)


def readable_cell(cell: Column, kind: T.DataType) -> Column:
    """A cell as a prompt shows it; real numbers stay in plain notation from 1e-4 up to 1e16."""
    if isinstance(kind, T.BooleanType):
        return cell.cast("int").cast("string")
    if not isinstance(kind, _REAL):
        return cell.cast("string")
    real = cell.cast("double")
    text = real.cast("string")
    plain = F.regexp_replace(text.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0*$", "$1")
    short = F.regexp_replace(F.lower(text), r"\.0e|e", "e")
    short = F.regexp_replace(short, r"e(\d)", "e+$1")
    short = F.regexp_replace(short, r"e([+-])(\d)$", "e$10$2")
    size = F.abs(real)
    return (
        F.when(F.isnan(real), "nan")
        .when(size == float("inf"), F.when(real > 0, "inf").otherwise("-inf"))
        .when((real == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(short)
    )
