"""Result comparison, evaluation, triage and reports on small cases."""

import random

from pyspark.sql import functions as F

from sqlcorpus import schemas as S
from sqlcorpus.operators import compare, evaluate, reports, triage, validate
from sqlcorpus.operators.compare import compare_results, result_rows, set_equal


def rows_of(spark, side, pair, values, kind):
    df = spark.createDataFrame(values, kind)
    return result_rows(df, F.lit(pair), side, df.columns)


def compared(spark, cases):
    """``{pair: (gold rows, its type, predicted rows, its type)}``"""
    parts = []
    for pair, (gold, gold_kind, pred, pred_kind) in cases.items():
        if gold:
            parts.append(rows_of(spark, "gold", pair, gold, gold_kind))
        if pred:
            parts.append(rows_of(spark, "pred", pair, pred, pred_kind))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    runs = spark.createDataFrame([(pair, True, True) for pair in cases], "pair_id string, gold_ok boolean, pred_ok boolean")
    return {row["pair_id"]: row for row in compare_results(rows, runs).collect()}


def test_types_and_nulls(spark):
    got = compared(spark, {
        "int and double": ([(1,)], "a int", [(1.0,)], "b double"),
        "int and text": ([(1,)], "a int", [("1",)], "b string"),
        "int and true": ([(1,)], "a int", [(True,)], "b boolean"),
        "nulls": ([(None, 2)], "a int, b int", [(None, 2)], "a string, b bigint"),
        "column order": ([(1, 2)], "a int, b int", [(2, 1)], "a int, b int"),
        "duplicates": ([(1,), (1,), (2,)], "a int", [(2,), (1,)], "a int"),
        "wider": ([(1,)], "a int", [(1, 1)], "a int, b int"),
        "missing": ([(1,), (2,)], "a int", [(1,)], "a int"),
        "one side": ([(1,)], "a int", [], "a int"),
        "both empty": ([], "a int", [], "a int"),
    })
    matching = {pair for pair, row in got.items() if row["match_status"]}
    assert matching == {"int and double", "int and true", "nulls", "duplicates", "both empty"}
    row = got["duplicates"]
    assert (row["num_gold_rows"], row["num_predicted_rows"], row["num_gold_cols"]) == (3, 2, 1)
    assert got["both empty"]["num_gold_cols"] == 0


def test_failed_statements(spark):
    rows = rows_of(spark, "gold", "p", [(1,)], "a int").union(rows_of(spark, "pred", "p", [(1,)], "a int"))
    for gold_ok, pred_ok, error in ((False, True, None), (True, False, "no such table")):
        runs = spark.createDataFrame(
            [("p", gold_ok, pred_ok, ["a"], ["a"], "no such table")],
            "pair_id string, gold_ok boolean, pred_ok boolean, gold_cols array<string>, pred_cols array<string>, error_msg string",
        )
        row = compare_results(rows, runs).first()
        assert not row["match_status"] and not row["predict_exec_status"] and row["gold_exec_status"] == gold_ok
        assert (row["num_gold_rows"], row["num_predicted_rows"], row["gold_cols"], row["predicted_cols"]) == (0, 0, [], [])
        assert row["error_msg"] == error


def test_random_pairs_against_sets(spark):
    rng = random.Random(2)
    pairs = {
        str(i): [[tuple(rng.choice([None, 0, 1]) for _ in range(2)) for _ in range(rng.randint(0, 3))] for _ in "gp"]
        for i in range(200)
    }
    flat = [
        (pair, side, a, b) for pair, sides in pairs.items()
        for side, values in zip(("gold", "pred"), sides) for a, b in values
    ]
    df = spark.createDataFrame(flat, "pair_id string, side string, a int, b int")
    runs = spark.createDataFrame([(pair, True, True) for pair in pairs], "pair_id string, gold_ok boolean, pred_ok boolean")
    got = compare_results(result_rows(df, F.col("pair_id"), F.col("side"), ["a", "b"]), runs).collect()
    assert {row["pair_id"]: row["match_status"] for row in got} == {
        pair: set(gold) == set(pred) for pair, (gold, pred) in pairs.items()
    }


def test_set_equal(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "b")], "a int, b string")
    right = spark.createDataFrame([(2, "b"), (1, None)], "x int, y string")
    assert set_equal(left, right).first()[0]
    assert not set_equal(left, right.limit(1)).first()[0]


def test_evaluate(spark):
    predictions = spark.createDataFrame(
        [("1", "```sql\nSELECT 1\n```", "SELECT 1", "a"), ("2", "SELECT 2", "SELECT 3", "a"), ("3", None, "SELECT 4", "b")],
        "question_id string, predicted_sql string, gold_sql string, level string",
    )
    outcome = spark.createDataFrame(
        [("1", True, True, True), ("2", False, False, False), ("3", True, False, False)],
        "question_id string, gold_exec_status boolean, predict_exec_status boolean, match_status boolean",
    )
    row = evaluate.evaluate(predictions, outcome).first()
    assert round(row["exact_match_accuracy"], 6) == round(100 / 3, 6) == round(row["execution_accuracy"], 6)
    assert (row["total_samples"], row["gold_query_execution_failures"]) == (3, 1)
    assert (row["predicted_query_execution_failures"], row["predicted_failures_given_gold_ok"]) == (2, 1)
    assert evaluate.evaluate(predictions, outcome, raw=True).first()["exact_match_accuracy"] == 0
    assert evaluate.evaluate(predictions.limit(0), outcome).first()["execution_accuracy"] == 0
    assert {r["level"]: r["total_samples"] for r in evaluate.evaluate(predictions, outcome, ["level"]).collect()} == {"a": 2, "b": 1}


def test_success_is_strict(spark):
    df = spark.createDataFrame(
        [(1, "Success", True), (2, "Success", None), (3, "Error", True), (4, None, True), (5, "Success", False)],
        "i int, generation_status string, execution_match boolean",
    )
    assert [row["i"] for row in df.filter(triage.is_success()).collect()] == [1]


def test_stored_label_wins(spark):
    questions = spark.createDataFrame([("1", "d", S.LEVEL_1), ("2", "d", S.LEVEL_1)], "question_id string, db_id string, level string")
    stored = spark.createDataFrame(
        [("1", S.LEVEL_2, "Success", True)], "question_id string, level string, generation_status string, execution_match boolean"
    )
    got = {row["question_id"]: (row["level"], row["cache_state"]) for row in triage.triage(questions, stored).collect()}
    assert got == {"1": (S.LEVEL_2, "success"), "2": (S.LEVEL_1, "candidate")}


def test_validation(spark):
    df = spark.createDataFrame(
        [("1", "d", None, "x"), (None, "d", "q", "x"), ("3", None, "q", "x"), ("4", "d", "q", ""), ("5", "d", "q", None)],
        "question_id string, db_id string, gold_sql string, level string",
    )
    assert [row["question_id"] for row in validate.validate_questions(df).collect()] == ["1"]
    assert tuple(validate.validation_report(df).first()) == (5, 1, 1, 1, 1, 2)


def test_reports(spark, workspace):
    filled = spark.createDataFrame(
        [(S.TRAIN, S.LEVEL_1, "a"), (S.TRAIN, None, "b"), (S.TRAIN, S.LEVEL_1, "z")], "split string, level string, db_id string"
    )
    lines = {row["level"]: row for row in reports.level_distribution(filled).collect()}
    assert lines[S.LEVEL_OTHER]["n"] == 1 and lines[reports.TOTAL]["n"] == 3 and lines[reports.TOTAL]["pct"] == 100
    text = reports.format_distribution(reports.level_distribution(filled), "Train")
    assert text.splitlines()[-1].startswith("| Total") and "66.7 %" in text
    assert "empty" in reports.format_distribution(reports.level_distribution(filled.limit(0)), "Train")
    assert reports.level_distribution(filled.limit(0)).count() == 0
    goal = spark.createDataFrame([(S.TRAIN, S.LEVEL_1, 4), (S.TRAIN, S.LEVEL_2, 0)], "split string, level string, target bigint")
    got = {row["level"]: tuple(row)[2:] for row in reports.target_vs_filled(filled, goal).collect()}
    assert got == {S.LEVEL_1: (4, 2, 50.0), S.LEVEL_2: (0, 0, 0.0), reports.TOTAL: (4, 3, 75.0)}
    lines = reports.format_target_vs_filled(reports.target_vs_filled(filled, goal), S.TRAIN).splitlines()
    assert [cell.strip() for cell in lines[-1].split("|")[2:4]] == ["4", "3"]
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "db_id string")
    coverage = reports.database_coverage(filled, expected)
    assert {row["db_id"]: row["missing"] for row in coverage.collect()} == {"a": False, "b": False, "c": True}
    folder = workspace.path("coverage")
    lines = reports.format_coverage(coverage, "Train", folder).splitlines()
    assert [[cell.strip() for cell in line.split("|")[1:4]] for line in lines[-2:]] == [["with rows", "2", "66.7 %"], ["without rows", "1", "33.3 %"]]
    assert [tuple(r) for r in spark.read.csv(folder, header=True).orderBy("db_id").collect()][-1] == ("c", "0", "true")
    dirty = spark.range(3000).select(F.lit(S.TRAIN).alias("split"), F.concat(F.lit("x"), "id").alias("level"))
    assert len(reports.format_distribution(reports.level_distribution(dirty), "Train").splitlines()) == 6
    summary = reports.coverage_summary(coverage).first()
    assert (summary["covered"], summary["total"], round(summary["pct"], 2)) == (2, 3, 66.67)
    assert [row[0] for row in reports.missing_databases(filled, expected).collect()] == ["c"]
