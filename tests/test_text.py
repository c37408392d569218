"""Golden texts of the column functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sqlcorpus import schemas as S
from sqlcorpus.functions import labels, text
from sqlcorpus.functions.cells import canonical_cell, readable_cell
from sqlcorpus.functions.prompts import close_prompt, render_template, template_chars
from sqlcorpus.functions.tables import dedupe_columns, render_table

FENCE = "```"


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_labels(spark):
    cases = {
        "SELECT COUNT(*) FROM t": S.LEVEL_1,
        "select a from t join u on 1 = 1": S.LEVEL_3,
        "SELECT a FROM t WHERE x > (SELECT 1)": S.LEVEL_2,
        "SELECT a FROM t UNION SELECT b FROM u": S.LEVEL_4,
        "SELECT joined_at FROM members": S.LEVEL_3,
        "SELECT reunion FROM t": S.LEVEL_3,
        "PRAGMA selected": S.LEVEL_1,
        "SELECT a FROM t, u": S.LEVEL_1,
        "DELETE FROM t": S.LEVEL_OTHER,
        "": S.LEVEL_OTHER,
        None: S.LEVEL_OTHER,
    }
    assert apply(spark, labels.classify_sql, list(cases)) == list(cases.values())
    bounded = apply(spark, lambda c: labels.classify_sql(c, True), ["SELECT joined_at FROM m", "PRAGMA selected"])
    assert bounded == [S.LEVEL_1, S.LEVEL_OTHER]


def test_level_rank_follows_the_declared_order(spark):
    assert apply(spark, labels.level_rank, [*S.LEVELS, "unheard of"]) == [0, 1, 2, 3, 4, 5]


def test_clean_sql(spark):
    cases = {
        "SELECT 1": "SELECT 1",
        "select 1": "select 1",
        "-- first\nSELECT 1 ;": "SELECT 1",
        f"{FENCE}sql\nSELECT 1;\n{FENCE}": "SELECT 1",
        f"{FENCE}sqlite\nSELECT 1\n{FENCE}": "SELECT 1",
        f"{FENCE}\nname FROM t\n{FENCE}": "SELECT name FROM t",
        "SELECT '--x' FROM t -- y": "SELECT '--x' FROM t",
        "SELECT 'it''s -- /* ok */' /* gone\n too */ , 2": "SELECT 'it''s -- /* ok */'  , 2",
        "WITH t AS (SELECT 1) SELECT * FROM t;;": "WITH t AS (SELECT 1) SELECT * FROM t",
        "withdrawn FROM t": "SELECT withdrawn FROM t",
        "SELECT a /* never closed": "SELECT a /* never closed",
        "  \n": "",
        None: "",
    }
    assert apply(spark, text.clean_sql, list(cases)) == list(cases.values())


def test_clean_sql_keeps_long_literals(spark):
    long = "SELECT '" + "x -- " * 200_000 + "'"
    assert apply(spark, text.clean_sql, [long + " -- end"]) == [long]


def test_extract_with_reasoning(spark):
    cases = [
        f"plan\n{FENCE}sql\nSELECT 1\n{FENCE} tail",
        f"plan {FENCE}sqlite SELECT 2;{FENCE}{FENCE}sql SELECT 3{FENCE}",
        f"{FENCE}\nSELECT 4{FENCE}",
        f"open {FENCE}sql SELECT 5",
        "nothing",
        None,
    ]
    got = [tuple(row) for row in apply(spark, text.extract_with_reasoning, cases)]
    assert got == [
        ("SELECT 1", "plan", S.SUCCESS),
        ("SELECT 2;", "plan", S.SUCCESS),
        ("SELECT 4", "", S.SUCCESS),
        *[(S.NO_SQL_BLOCK, None, S.FAILURE)] * 3,
    ]


def test_extract_sql(spark):
    cases = {
        f"<think>{FENCE}sql\nSELECT 0\n{FENCE}</think>x\n{FENCE}SQL\nSELECT 3\n{FENCE}": "SELECT 3;",
        f"plan\n{FENCE}\nSELECT 1\n{FENCE} tail": "SELECT 1\n tail;",
        f"plan\n{FENCE}sqlite\nSELECT 2;\n{FENCE}": "SELECT 2;",
        "steps\n  with t AS (SELECT 4 AS x)\nSELECT x FROM t": "with t AS (SELECT 4 AS x)\nSELECT x FROM t;",
        "the answer is: select 5": "the answer is: select 5;",
        "SELECT\nname FROM t": "SELECT\nname FROM t;",
        "With the plan done\nSELECT 1": "With the plan done\nSELECT 1;",
        f"{FENCE}sql\n \n{FENCE}\nSELECT 7": "SELECT 7;",
        "I cannot answer that.": "",
        "": "",
        None: "",
    }
    assert apply(spark, text.extract_sql, list(cases)) == list(cases.values())


def test_extract_sql_reads_whole_texts(spark):
    words = "word " * 400_000
    assert apply(spark, text.extract_sql, [f"{words}\nSELECT a\n{words}"]) == [f"SELECT a\n{words}".strip() + ";"]


def test_identifiers(spark):
    names = [' "Order Key" ', "`x`", "it's", None]
    assert apply(spark, text.canonical_name, names) == ["order key", "x", "its", None]
    assert apply(spark, text.quote_ident, ['a"b', "", None]) == ['"a""b"', '""', None]
    assert apply(spark, text.safe_id, ["a/b c", "q-1_2", "../up", "é1"]) == ["a_b_c", "q-1_2", "___up", "é1"]
    cells = ["z" * 50, "y" * 51, "", None]
    assert apply(spark, text.truncate_cell, cells) == ["z" * 50, "y" * 50 + "...", "", None]


def test_predictions(spark):
    df = spark.createDataFrame([("SELECT 1;", "shop")], "sql string, db_id string")
    value = df.select(text.format_prediction(F.col("sql"), F.col("db_id"))).first()[0]
    assert value == "SELECT 1;\t----- bird -----\tshop"
    parsed = apply(spark, text.parse_prediction, [value, "SELECT 2"])
    assert [tuple(row) for row in parsed] == [("SELECT 1;", "shop"), ("SELECT 2", None)]


@pytest.mark.parametrize(
    ("kind", "values", "expected"),
    [
        ("int", [1, None], ["n:1", None]),
        ("double", [1.0, 0.5, -0.0, 1e20, None], ["n:1", "n:0.5", "n:0", "n:100000000000000000000", None]),
        ("boolean", [True, False], ["n:1", "n:0"]),
        ("string", ["1", ""], ["t:1", "t:"]),
        ("decimal(20,2)", [Decimal("12345678901234567.89"), Decimal("12345678901234567.90"), Decimal("-5.00"), Decimal("0.00")],
         ["n:12345678901234567.89", "n:12345678901234567.9", "n:-5", "n:0"]),
        ("bigint", [10 ** 18], ["n:1000000000000000000"]),
        ("double", [1e18, 12345678.5, 0.0001], ["n:1000000000000000000", "n:12345678.5", "n:1.0E-4"]),
        ("decimal(10,4)", [Decimal("0.0001"), Decimal("12345.5000")], ["n:1.0E-4", "n:12345.5"]),
    ],
)
def test_canonical_cells(spark, kind, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = df.orderBy("i").select(canonical_cell(F.col("v"), df.schema["v"].dataType)).collect()
    assert [row[0] for row in got] == expected


def test_readable_cells_print_as_python_does(spark):
    values = [0.0, 1.5, 1e7, 12345678.9, 1e15, 1.5e16, 2e-4, 1.234567890123e-4, 3e-5, -1e7, 1e100, 0.1 + 0.2, 900.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.orderBy("i").select(readable_cell(F.col("v"), df.schema["v"].dataType)).collect()
    assert [row[0] for row in got] == [repr(v) for v in values]


def test_table_text(spark):
    df = spark.createDataFrame([(["id", "name"], [["1", "ann"], ["100", None]])], "h array<string>, r array<array<string>>")
    got = df.select(render_table(F.col("h"), F.col("r"))).first()[0]
    assert got == " id name \n  1  ann \n100 None "


def test_dedupe_columns(spark):
    got = apply(spark, dedupe_columns, [["a", "b", "a", "a"], []], "array<string>")
    assert got == [["a", "b", "a_1", "a_2"], []]


def test_template(spark):
    template = "{{x}} {a}-{b}|{a}"
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    assert df.select(render_template(template, {"a": F.col("a"), "b": F.col("b")})).first()[0] == "{x} {b}-|{b}"
    assert template_chars(template) == 6
    assert apply(spark, close_prompt, ["p \n\n", "q"]) == ["p\n", "q\n"]
