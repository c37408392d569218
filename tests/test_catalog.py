"""Catalog reading, look-ups and schema text."""

import json

import pytest

from sqlcorpus.operators import catalog as C
from sqlcorpus.operators import prompts
from sqlcorpus.sources.readers import read_catalog

SHOP = {
    "db_id": "shop", "table_names_original": ["Customer", "orders"], "table_names": ["client", "orders"],
    "column_names_original": [[-1, "*"], [0, "CustKey"], [0, "photo"], [1, "OrderKey"], [1, "LineNo"], [1, "cust"]],
    "column_names": [[-1, "*"], [0, "customer id"], [0, "photo"], [1, "order id"], [1, " "], [1, "buyer"]],
    "column_types": ["text", "integer", "blob", "integer", "integer", "integer"],
    "primary_keys": [1, [1, 0, 1], 99, -3], "foreign_keys": [[5, 1], [5, 99], [5], [-1, 1]],
}

LEGEND = """Legend:
  Human-friendly name: Real-world name for table/column.
  Desc: Description or human-friendly name of the column.
  PKs: Primary Keys.
  FKs: Foreign Keys."""

CUSTOMER = """Table: Customer
  Human-friendly Table name: client
  Column CustKey: Type -> integer, Desc -> customer id
  Column photo: Type -> blob, Desc -> photo
"""

ORDERS = """Table: orders
  Column OrderKey: Type -> integer, Desc -> order id
  Column LineNo: Type -> integer
  Column cust: Type -> integer, Desc -> buyer
"""


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "tables.json"
    older = {**SHOP, "table_names": ["old", "old"]}
    path.write_text(json.dumps([older, {"table_names_original": ["ignored"]}, SHOP], indent=1))
    return read_catalog(spark, str(path)).cache()


def test_reader_keeps_the_last_entry(catalog):
    assert [(row["db_id"], row["table_names"]) for row in catalog.collect()] == [("shop", ["client", "orders"])]


def test_columns(catalog):
    rows = [tuple(row) for row in C.catalog_columns(catalog).orderBy("col_idx").collect()]
    assert rows[0] == ("shop", 0, "Customer", "client", 1, "CustKey", "customer id", "integer")
    assert [row[4] for row in rows] == [1, 2, 3, 4, 5]


def test_keys(catalog):
    pks = [(row["table_name"], row["columns"]) for row in C.primary_keys(catalog).collect()]
    assert pks == [("Customer", ["CustKey"]), ("orders", ["OrderKey", "LineNo"])]
    fks = [tuple(row)[2:] for row in C.foreign_keys(catalog).collect()]
    assert fks == [("orders", "cust", "Customer", "CustKey")]


def test_schema_text(catalog):
    keys = "Primary Keys (PKs):\n  Customer.CustKey\n  orders.(OrderKey, LineNo)\n\nForeign Keys (FKs):\n  orders.cust -> Customer.CustKey\n\n"
    assert C.render_schema(catalog).first()["schema_text"] == f"{CUSTOMER}\n{ORDERS}\n{keys}{LEGEND}"


def test_schema_text_with_rows(spark, catalog):
    samples = spark.createDataFrame(
        [("shop", 1, 1, ["10", "1", None]), ("shop", 1, 2, ["200", "1", "7"]), ("shop", 7, 1, ["lost"])],
        "db_id string, table_idx int, row_no int, cells array<string>",
    )
    row = C.render_schema_with_rows(catalog, samples, [3, 1, 0]).first()
    two = "/*\n  2 rows from"
    block = "/*\n2 rows from orders table:\n  OrderKey LineNo cust \n        10      1 None \n       200      1    7 \n*/\n"
    expected = block.replace("\n  OrderKey", "\n  OrderKey").replace("\n        10", "\n        10 ".rstrip() + "")
    assert two not in row["context_3"]
    assert row["context_0"] == f"{CUSTOMER}\n{ORDERS}\n{LEGEND}"
    lines = row["context_3"].splitlines()
    at = lines.index("2 rows from orders table:")
    assert lines[at - 1 : at + 5] == [
        "/*", "2 rows from orders table:", "  OrderKey LineNo cust ", "        10      1 None ", "       200      1    7 ", "*/",
    ]
    assert "1 rows from orders table:" in row["context_1"] and expected


def test_ddl(catalog):
    assert C.render_ddl(catalog).first()["ddl"] == (
        'CREATE TABLE "Customer" (\n    "CustKey" integer,\n    "photo" blob,\n    PRIMARY KEY ("CustKey")\n)\n'
        'CREATE TABLE "orders" (\n    "OrderKey" integer,\n    "LineNo" integer,\n    "cust" integer,\n'
        '    PRIMARY KEY ("OrderKey", "LineNo"),\n    FOREIGN KEY ("cust") REFERENCES "Customer" ("CustKey")\n)'
    )
    annotated = C.render_ddl(catalog, annotate=True).first()["ddl"]
    assert annotated.startswith('CREATE TABLE "Customer" ( -- client\n    "CustKey" integer, -- customer id\n    "photo" blob,\n')
    assert '\n)\n\nCREATE TABLE "orders" (\n' in annotated and '"LineNo" integer,\n' in annotated


def test_database_without_entry_or_samples(spark, catalog):
    empty = spark.createDataFrame([], "db_id string, table_idx int, row_no int, cells array<string>")
    assert C.render_schema_with_rows(catalog, empty).first()["context_3"] == f"{CUSTOMER}\n{ORDERS}\n{LEGEND}"
    asked = spark.createDataFrame([("q", "none")], "question_id string, db_id string")
    assert C.lookup_catalog(asked, catalog).first()["table_names"] is None


def test_sample_rows(spark):
    df = spark.createDataFrame([(3, b"x", "c"), (1, b"y", "a" * 60), (2, None, None)], "id int, photo binary, name string")
    first = C.sample_rows(df, 2, ["id"])
    assert first.columns == ["id", "name"]
    cells = [row[0] for row in first.select(C.sample_cells(first, ["id", "name"])).collect()]
    assert cells == [["1", "a" * 50 + "..."], ["2", None]]


def test_prompts(spark):
    template = "{db_schema_context_hmr}|{nl_question}|{hint}|{format_instructions}"
    questions = spark.createDataFrame(
        [("1", "a", "why {hint}?", None), ("2", "b", "what?", "h"), ("3", "c", "?", None), ("4", "d", "?", None)],
        "question_id string, db_id string, question string, evidence string",
    )
    contexts = spark.createDataFrame(
        [("a", "x" * 3, "x", ""), ("b", "x" * 30, "x" * 5, ""), ("c", "x" * 30, "x" * 30, "x" * 30)],
        "db_id string, context_3 string, context_1 string, context_0 string",
    )
    got = {r["question_id"]: r for r in prompts.render_prompts(questions, contexts, template, 20).collect()}
    assert (got["1"]["num_rows"], got["1"]["prompt"]) == (3, "xxx|why {hint}?||")
    assert (got["2"]["num_rows"], got["2"]["prompt"]) == (1, "xxxxx|what?|h|")
    assert (got["3"]["num_rows"], got["3"]["prompt"], got["3"]["prompt_status"]) == (None, None, "ContextLimit")
    wide = {r["question_id"]: r for r in prompts.render_prompts(questions, contexts, template, 200).collect()}
    assert wide["4"]["prompt"] == "/* No schema metadata available for d. */|?||"
    twice = "{db_schema_context_hmr}" * 2 + "{nl_question}"
    for limit, rows in ((60 + 5, 3), (60 + 4, 1)):
        got = {r["question_id"]: r for r in prompts.render_prompts(questions, contexts, twice, limit).collect()}
        assert got["2"]["num_rows"] == rows and len(got["2"]["prompt"]) <= limit


def test_bake_takes_either_name_of_the_plan(spark):
    contexts = spark.createDataFrame([("a", "ctx")], "db_id string, context_3 string")
    curated = spark.createDataFrame(
        [("q?", "a", None, None, "reason", "SELECT 1", "train"), ("q?", "a", "h", "plan", "reason", "SELECT 2", "val_in_domain")],
        "question string, db_id string, evidence string, query_plan string, final_reasoning string, predicted_sql string, split string",
    )
    rows = prompts.bake(curated, contexts, "{db_schema_context_hmr}/{nl_question}/{hint}  \n").collect()
    assert [(r["prompt"], r["completion"]) for r in rows] == [
        ("ctx/q?/\n", "reason\n\n## SQL Query:\nSELECT 1"), ("ctx/q?/h\n", "plan\n\n## SQL Query:\nSELECT 2"),
    ]
    assert rows[0]["teacher_sql"] == "SELECT 1"
    assert prompts.combined_val(prompts.bake(curated, contexts, "x")).count() == 1
