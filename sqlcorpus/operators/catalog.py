"""Schema catalogs: look-ups of columns and keys, and their rendering for prompts.

A catalog has one row a database, holding all its tables in arrays. Names and keys refer to each
other by position inside that row, so look-ups and rendering stay inside the row and shuffle
nothing; only sample rows are brought in by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sqlcorpus.functions.cells import readable_cell
from sqlcorpus.functions.tables import render_table
from sqlcorpus.functions.text import let, quote_ident, strip, truncate_cell
from sqlcorpus.sources.heads import HEADS, SHAPES, columns_of, read_heads

UNKNOWN_TYPE = "UNKNOWN"
BLOB = "BLOB"
# Tasks over which the entries of one database are spread before they are merged.
SHARES = 64
# Tables a storage engine keeps for itself.
INTERNAL_TABLES = ["sqlite_sequence"]
# The closing lines of every schema text.
LEGEND = [
    "Legend:",
    "  Human-friendly name: Real-world name for table/column.",
    "  Desc: Description or human-friendly name of the column.",
    "  PKs: Primary Keys.",
    "  FKs: Foreign Keys.",
]


def latest_catalog(df: DataFrame, position: str = "position") -> DataFrame:
    """One entry a database: entries without a name are skipped, a later entry replaces an earlier.

    An entry holds a whole database, and entries are sorted by name to be merged. They are spread by name and share of
    positions and merged there, then by name, so at most ``SHARES`` entries of a name gather in a task. Both times the
    session's number of shuffle partitions is kept: small when compressed, entries would be coalesced into few tasks.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    named = df.filter(F.coalesce(F.col("db_id"), F.lit("")) != "")
    others = [name for name in df.columns if name not in ("db_id", position)]
    # The position itself goes along as ``_at``; its column holds its share from here on. With the name in its digest the
    # share is no constant, which Spark would drop from the keys, even if all positions are one.
    share = F.pmod(F.xxhash64("db_id", position), F.lit(SHARES)).cast("int").alias(position)
    last = named.select("db_id", share, F.col(position).alias("_at"), F.struct(*others).alias("_last"))
    for keys in (["db_id", position], ["db_id"]):
        last = last.repartition(tasks, *keys).groupBy(*keys).agg(
            F.max("_at").alias("_at"), F.max_by("_last", "_at").alias("_last"))
    return last.select("db_id", *[F.col(f"_last.{name}").alias(name) for name in others])


def lookup_catalog(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with the catalog entry of their database; null where there is none."""
    return df.join(catalog, "db_id", "left")


def _columns() -> Column:
    """``array<struct>`` of the real columns of a catalog row, each with its table and global index."""
    every = F.transform(
        "column_names_original",
        lambda pair, i: F.struct(
            F.get(pair, F.lit(0)).try_cast("int").alias("table_idx"),
            F.get("table_names_original", F.get(pair, F.lit(0)).try_cast("int")).alias("table_name"),
            F.get("table_names", F.get(pair, F.lit(0)).try_cast("int")).alias("table_friendly"),
            i.alias("col_idx"),
            F.get(pair, F.lit(1)).alias("col_name"),
            F.get(F.get("column_names", i), F.lit(1)).alias("col_friendly"),
            F.coalesce(F.get("column_types", i), F.lit(UNKNOWN_TYPE)).alias("col_type"),
        ),
    )
    return F.filter(every, lambda column: column["table_name"].isNotNull())


def _column_at(index: Column) -> Column:
    """The column of a global index as ``struct<table_name, col_name>``; nulls if out of range."""
    pair = F.get("column_names_original", index)
    return F.struct(
        F.get("table_names_original", F.get(pair, F.lit(0)).try_cast("int")).alias("table_name"),
        F.get(pair, F.lit(1)).alias("col_name"),
    )


def _primary_keys() -> Column:
    """``array<struct<table_name, columns>>``: scalar entries are global, lists count in their table."""

    def single(entry: Column) -> Column:
        column = _column_at(entry.try_cast("int"))
        return F.struct(
            column["table_name"].alias("table_name"),
            F.array(column["col_name"]).alias("columns"),
            F.lit(False).alias("composite"),
        )

    def composite(entry: Column) -> Column:
        inside = F.split(F.translate(entry, "[] ", ""), ",")
        return let(F.transform(inside, lambda number: number.try_cast("int")), of_numbers)

    def of_numbers(numbers: Column) -> Column:
        table_idx = F.get(numbers, F.lit(0))
        of_table = F.filter("column_names_original", lambda pair: F.get(pair, F.lit(0)).try_cast("int") == table_idx)
        names = F.transform(
            F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0))),
            lambda place: F.get(F.get(of_table, place), F.lit(1)),
        )
        return F.struct(
            F.get("table_names_original", table_idx).alias("table_name"),
            F.filter(names, lambda name: name.isNotNull()).alias("columns"),
            F.lit(True).alias("composite"),
        )

    resolved = F.transform(
        F.coalesce("primary_keys", F.array().cast("array<string>")),
        lambda entry: F.when(F.startswith(F.trim(entry), F.lit("[")), composite(entry)).otherwise(single(entry)),
    )
    return F.filter(
        resolved,
        lambda key: key["table_name"].isNotNull()
        & (F.size(key["columns"]) > 0)
        & F.get(key["columns"], F.lit(0)).isNotNull(),
    )


def _foreign_keys() -> Column:
    """``array<struct<from_table, from_column, to_table, to_column>>`` of the pairs that resolve."""
    resolved = F.transform(
        F.filter(
            F.coalesce("foreign_keys", F.array().cast("array<array<int>>")), lambda pair: F.size(pair) == 2
        ),
        lambda pair: F.struct(
            _column_at(F.get(pair, F.lit(0)))["table_name"].alias("from_table"),
            _column_at(F.get(pair, F.lit(0)))["col_name"].alias("from_column"),
            _column_at(F.get(pair, F.lit(1)))["table_name"].alias("to_table"),
            _column_at(F.get(pair, F.lit(1)))["col_name"].alias("to_column"),
        ),
    )
    return F.filter(
        resolved, lambda key: key["from_table"].isNotNull() & key["to_table"].isNotNull()
    )


def catalog_tables(catalog: DataFrame) -> DataFrame:
    """One row a table: index, name, readable name."""
    names = catalog.select("db_id", "table_names", F.posexplode("table_names_original").alias("table_idx", "table_name"))
    return names.select("db_id", "table_idx", "table_name", F.get("table_names", "table_idx").alias("table_friendly"))


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """One row a column, with its table, readable names and type; the ``*`` entry drops out."""
    return catalog.select("db_id", F.inline(_columns()))


def primary_keys(catalog: DataFrame) -> DataFrame:
    """One row a primary key: its table and columns."""
    keys = catalog.select("db_id", F.posexplode(_primary_keys()).alias("pk_no", "key"))
    return keys.select("db_id", "pk_no", "key.table_name", "key.columns")


def foreign_keys(catalog: DataFrame) -> DataFrame:
    """One row a foreign key: the columns on both ends."""
    keys = catalog.select("db_id", F.posexplode(_foreign_keys()).alias("fk_no", "key"))
    return keys.select("db_id", "fk_no", "key.*")


def _tables() -> Column:
    """``array<struct<table_idx, table_name, friendly, columns>>`` of a catalog row."""

    def of_each(columns: Column) -> Column:
        return F.transform(
            F.coalesce("table_names_original", F.array().cast("array<string>")),
            lambda name, i: F.struct(
                i.alias("table_idx"),
                name.alias("table_name"),
                F.get("table_names", i).alias("friendly"),
                F.filter(columns, lambda column: column["table_idx"] == i).alias("columns"),
            ),
        )

    return let(_columns(), of_each)


def _blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def _description(table: Column) -> Column:
    """Description of one table."""
    name, friendly = table["table_name"], table["friendly"]
    named = ~_blank(friendly) & (friendly != name)
    lines = F.transform(
        table["columns"],
        lambda column: F.concat(
            F.lit("\n  Column "), column["col_name"], F.lit(": Type -> "), column["col_type"],
            F.when(_blank(column["col_friendly"]), "").otherwise(
                F.concat(F.lit(", Desc -> "), column["col_friendly"])
            ),
        ),
    )
    return F.concat(
        F.lit("Table: "), name,
        F.when(named, F.concat(F.lit("\n  Human-friendly Table name: "), friendly)).otherwise(""),
        F.array_join(lines, ""),
    )


def _section(heading: str, lines: Column) -> Column:
    """A section with its heading and a blank line behind it, or nothing."""
    return let(lines, lambda lines: F.when(
        F.size(lines) > 0, F.concat(F.lit(heading + "\n"), F.array_join(lines, "\n"), F.lit("\n\n"))
    ).otherwise(""))


def describe_tables(catalog: DataFrame) -> DataFrame:
    """One row a table: its description, as the schema text shows it."""
    texts = F.transform(
        _tables(),
        lambda table: F.struct(
            table["table_idx"].alias("table_idx"), table["table_name"].alias("table_name"),
            _description(table).alias("description"),
        ),
    )
    return catalog.select("db_id", F.inline(texts))


def render_schema(catalog: DataFrame) -> DataFrame:
    """``db_id, schema_text``: tables, columns, primary and foreign keys, legend."""
    tables = F.transform(_tables(), lambda table: F.concat(_description(table), F.lit("\n\n")))
    pks = F.transform(
        _primary_keys(),
        lambda key: F.concat(
            F.lit("  "), key["table_name"], F.lit("."),
            F.when(key["composite"], F.concat(F.lit("("), F.array_join(key["columns"], ", "), F.lit(")")))
            .otherwise(F.get(key["columns"], F.lit(0))),
        ),
    )
    fks = F.transform(
        _foreign_keys(),
        lambda key: F.concat(
            F.lit("  "), key["from_table"], F.lit("."), key["from_column"], F.lit(" -> "),
            key["to_table"], F.lit("."), key["to_column"],
        ),
    )
    text = F.concat(
        F.array_join(tables, ""), _section("Primary Keys (PKs):", pks), _section("Foreign Keys (FKs):", fks),
        F.lit("\n".join(LEGEND)),
    )
    return catalog.select("db_id", strip(text).alias("schema_text"))


def sample_cells(df: DataFrame, columns: list[str]) -> Column:
    """Cells of a row as prompt text, long texts cut."""
    cells = [truncate_cell(readable_cell(F.col(name), df.schema[name].dataType)) for name in columns]
    return F.array(*cells)


def sample_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first rows of a table by a key, without its binary columns."""
    plain = [field.name for field in df.schema if field.dataType.typeName() != "binary"]
    return df.select(*plain).orderBy(*order_by).limit(n)


def sample_databases(spark: SparkSession, tables: DataFrame, n: int = 3, tasks: int | None = None) -> DataFrame:
    """``db_id, table_name, row_no, header, cells``: the first ``n`` rows of stored tables, in file order.

    ``tables`` has ``db_id, table_name, path``, as ``discover_databases`` finds them. Names are dealt out to ``tasks``
    tasks, each of which opens its tables one by one, reads what holds their first rows, and closes them: any number
    of tables, each with columns of its own, is one job, and the driver sees none of them. Binary columns are left out
    and long cells cut; a table that cannot be read, or holds no rows, is left out. Paths are on a file system that
    pyarrow opens by its address.
    """
    named = tables.select(*[F.col(c).cast("string") for c in ("db_id", "table_name", "path")])
    dealt = named.repartition(tasks or spark.sparkContext.defaultParallelism, "path")
    heads = dealt.mapInArrow(lambda batches: read_heads(batches, n), HEADS)

    def shown(cell: Column) -> Column:
        text = F.when(cell["real"].isNotNull(), readable_cell(cell["real"], T.DoubleType())).when(
            cell["micros"].isNotNull(), F.timestamp_micros(cell["micros"]).cast("string")).otherwise(cell["text"])
        return truncate_cell(text)

    return heads.withColumn("cells", F.transform("cells", shown))


def live_ddl(spark: SparkSession, tables: DataFrame, tasks: int | None = None) -> DataFrame:
    """``db_id, ddl``: a CREATE TABLE statement for each stored table as it is now, in the order of their names.

    ``tables`` are as ``sample_databases`` takes them; one footer of each is read, by the task that holds its name.
    A table that cannot be read is left out. Stored tables have no keys, so the statements have none.
    """
    named = tables.select(*[F.col(c).cast("string") for c in ("db_id", "table_name", "path")])
    dealt = named.repartition(tasks or spark.sparkContext.defaultParallelism, "path")
    shapes = dealt.mapInArrow(columns_of, SHAPES)
    lines = F.zip_with("names", "kinds", lambda name, kind: F.concat(F.lit("    "), quote_ident(name), F.lit(" "), kind))
    statement = F.concat(F.lit("CREATE TABLE "), quote_ident(F.col("table_name")), F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n)"))
    one = shapes.select("db_id", F.struct("table_name", statement.alias("ddl")).alias("_table"))
    ordered = one.groupBy("db_id").agg(F.array_sort(F.collect_list("_table")).alias("_tables"))  # of one database
    return ordered.select("db_id", F.array_join("_tables.ddl", "\n").alias("ddl"))


def number_samples(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """``db_id, table_idx, row_no, cells`` of ``sample_databases``, as ``render_schema_with_rows`` takes them."""
    listed = catalog.select("db_id", F.posexplode("table_names_original").alias("table_idx", "_name"))
    keyed = samples.withColumn("_key", F.lower("table_name"))
    return keyed.join(listed.withColumn("_key", F.lower("_name")), ["db_id", "_key"]).select(
        "db_id", "table_idx", "row_no", "cells")


def sample_tables(rows: DataFrame, n: int, order_by: list[str], tables: list[str] = ("db_id", "table_idx")) -> DataFrame:
    """The first ``n`` rows of each of many tables kept in one, numbered from 1.

    The plain limit lets each task keep ``n`` rows a table before the shuffle.
    """
    by_table = Window.partitionBy(*tables).orderBy(*order_by)
    return rows.withColumn("row_no", F.row_number().over(by_table)).filter(F.col("row_no") <= n)


def collect_samples(samples: DataFrame, n: int) -> DataFrame:
    """``db_id, samples map<table_idx, array<array<string>>>`` of at most ``n`` rows a table.

    Input: ``db_id, table_idx, row_no, cells``. Groups are bounded: ``n`` rows a table, and the
    tables one catalog row lists.
    """
    kept = samples.filter(F.col("row_no") <= n)
    by_table = kept.groupBy("db_id", "table_idx").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("_rows")
    )
    cells = F.transform("_rows", lambda row: row["cells"])
    return by_table.groupBy("db_id").agg(
        F.map_from_entries(F.collect_list(F.struct("table_idx", cells.alias("rows")))).alias("samples")
    )


def _sample_block(table: Column, num_rows: int) -> Column:
    """The first rows of one table as text, or nothing."""
    rows = F.slice(table["rows"], F.lit(1), F.lit(num_rows))
    shown = let(rows, lambda rows: F.when(
        (F.size(rows) > 0) & (F.size(table["header"]) > 0),
        F.concat(
            F.lit("/*\n"), F.size(rows).cast("string"), F.lit(" rows from "), table["table_name"], F.lit(" table:\n  "),
            F.replace(render_table(table["header"], rows), F.lit("\n"), F.lit("\n  ")), F.lit("\n*/\n"),
        ),
    ))
    return F.coalesce(shown, F.lit(""))


def render_schema_with_rows(
    catalog: DataFrame, samples: DataFrame, num_rows: list[int] = (3,)
) -> DataFrame:
    """``db_id`` and one text column ``context_<n>`` for each number of sample rows.

    The samples of a table list its columns in catalog order, binary ones left out.
    """
    # Text is long work on short rows: the join's shuffle keeps all cores busy instead of being coalesced by size.
    spark = catalog.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = catalog.repartition(tasks, "db_id").join(collect_samples(samples, max(num_rows)), "db_id", "left")

    def with_rows(table: Column) -> Column:
        plain = F.filter(table["columns"], lambda column: F.upper(column["col_type"]) != BLOB)
        return F.struct(
            table["table_name"].alias("table_name"),
            _description(table).alias("description"),
            F.transform(plain, lambda column: column["col_name"]).alias("header"),
            F.try_element_at("samples", table["table_idx"]).alias("rows"),
        )

    def text(tables: Column, n: int) -> Column:
        parts = F.transform(
            tables,
            lambda table: F.concat(
                table["description"], F.lit("\n"), _sample_block(table, n) if n else F.lit(""), F.lit("\n")
            ),
        )
        return strip(F.concat(F.array_join(parts, ""), F.lit("\n".join(LEGEND))))

    texts = let(
        F.transform(_tables(), with_rows),
        lambda tables: F.struct(*[text(tables, n).alias(f"context_{n}") for n in num_rows]),
    )
    return held.select("db_id", texts.alias("_texts")).select("db_id", "_texts.*")


def render_ddl(catalog: DataFrame, annotate: bool = False) -> DataFrame:
    """``db_id, ddl``: CREATE TABLE statements made from the catalog.

    ``annotate`` adds readable names as comments, where they differ from the names themselves.
    """

    def remark(friendly: Column, name: Column) -> Column:
        if not annotate:
            return F.lit("")
        return F.when(~_blank(friendly) & (friendly != name), F.concat(F.lit(" -- "), friendly)).otherwise("")

    def idents(names: Column) -> Column:
        return F.array_join(F.transform(names, quote_ident), ", ")

    def part(line: Column, comment: Column) -> Column:
        return F.struct(line.alias("line"), comment.alias("remark"))

    def statement(table: Column, keys: Column) -> Column:
        name = table["table_name"]
        columns = F.transform(
            table["columns"],
            lambda column: part(
                F.concat(quote_ident(column["col_name"]), F.lit(" "), column["col_type"]),
                remark(column["col_friendly"], column["col_name"]),
            ),
        )
        pks = F.transform(
            F.filter(keys["pks"], lambda key: key["table_name"] == name),
            lambda key: part(F.concat(F.lit("PRIMARY KEY ("), idents(key["columns"]), F.lit(")")), F.lit("")),
        )
        fks = F.transform(
            F.filter(keys["fks"], lambda key: key["from_table"] == name),
            lambda key: part(
                F.concat(
                    F.lit("FOREIGN KEY ("), quote_ident(key["from_column"]), F.lit(") REFERENCES "),
                    quote_ident(key["to_table"]), F.lit(" ("), quote_ident(key["to_column"]), F.lit(")"),
                ),
                F.lit(""),
            ),
        )

        def body(parts: Column) -> Column:
            lines = F.transform(
                parts,
                lambda entry, at: F.concat(
                    F.lit("    "), entry["line"], F.when(at < F.size(parts) - 1, ",").otherwise(""), entry["remark"]
                ),
            )
            return F.array_join(lines, "\n")

        return F.concat(
            F.lit("CREATE TABLE "), quote_ident(name), F.lit(" ("), remark(table["friendly"], name),
            F.lit("\n"), let(F.concat(columns, pks, fks), body), F.lit("\n)"),
        )

    tables = F.filter(_tables(), lambda table: ~table["table_name"].isin(INTERNAL_TABLES))
    keys = F.struct(_primary_keys().alias("pks"), _foreign_keys().alias("fks"))
    ddl = let(keys, lambda keys: F.transform(tables, lambda table: statement(table, keys)))
    return catalog.select("db_id", F.array_join(ddl, "\n\n" if annotate else "\n").alias("ddl"))
