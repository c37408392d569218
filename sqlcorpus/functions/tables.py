"""Small tables as aligned text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sqlcorpus.functions.text import let

NULL_TEXT = "None"


def table_widths(header: Column, rows: Column) -> Column:
    """Characters of the widest cell of each column, the header included."""

    def width(name: Column, i: Column) -> Column:
        cells = F.transform(rows, lambda row: F.length(F.coalesce(F.get(row, i), F.lit(NULL_TEXT))))
        return F.greatest(F.length(name), F.coalesce(F.array_max(cells), F.lit(0)))

    return F.transform(header, width)


def render_table(header: Column, rows: Column) -> Column:
    """Right-aligned text of ``array<string>`` header and ``array<array<string>>`` rows.

    Every cell is followed by one space; a null reads ``None``.
    """

    def table(widths: Column) -> Column:
        def line(cells: Column) -> Column:
            padded = F.transform(
                cells,
                lambda cell, i: F.concat(
                    F.lpad(F.coalesce(cell, F.lit(NULL_TEXT)), F.get(widths, i), F.lit(" ")), F.lit(" ")
                ),
            )
            return F.array_join(padded, "")

        return F.concat(line(header), F.lit("\n"), F.array_join(F.transform(rows, line), "\n"))

    return let(table_widths(header, rows), table)


def dedupe_columns(names: Column) -> Column:
    """Column names of one query with repeats numbered: the second ``x`` is ``x_1``, the third ``x_2``."""

    def unique(name: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda other: other == name))
        return F.when(before > 0, F.concat(name, F.lit("_"), before.cast("string"))).otherwise(name)

    return F.transform(names, unique)
