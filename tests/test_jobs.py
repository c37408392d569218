"""Readers, writers, generation, execution and streams end to end."""

import json
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow import fs as pa_fs
from pyspark.sql import functions as F

from sqlcorpus import schemas as S
from sqlcorpus.operators import catalog as C
from sqlcorpus.operators.answers import AnswerLog, Pieces, ask_logged
from sqlcorpus.operators.compare import compare_results
from sqlcorpus.operators.execute import execute_pairs
from sqlcorpus.operators.generate import ContextLengthExceeded, generate, verify_candidates, with_retry
from sqlcorpus.operators.validate import assign_question_id
from sqlcorpus.plans.bake import run_bake
from sqlcorpus.plans.curate import Settings, curate, fetch_curated, run_curation
from sqlcorpus.plans.label import label_corpus
from sqlcorpus.plans.predict import predict, score
from sqlcorpus.sources import readers, writers
from sqlcorpus.sources.manifest import Manifest
from sqlcorpus.streaming.ingest import ingest_batch, question_bucket, read_ingested, stored_in, stream_ingest
from workload import queries as Q

from .conftest import SF_SMALL


def write_json(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_read_questions(spark, tmp_path):
    rows = [
        {"db_id": "a", "question": "q0", "SQL": "SELECT 1"},
        {"question_id": 17, "db_id": "a", "question": "q1", "SQL": "SELECT 2", "evidence": "e"},
        {"db_id": "b", "question": "q2", "SQL": None},
    ]
    path = write_json(tmp_path / "q.json", rows)
    df = assign_question_id(readers.read_questions(spark, path, with_position=True))
    got = [(r["question_id"], r["db_id"], r["gold_sql"], r["evidence"]) for r in df.orderBy("question").collect()]
    assert got == [("0", "a", "SELECT 1", None), ("17", "a", "SELECT 2", "e"), ("2", "b", None, None)]
    with pytest.raises(FileNotFoundError):
        readers.read_questions(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        readers.read_questions(spark, write_json(tmp_path / "object.json", {"db_id": "a"}))
    (tmp_path / "broken.json").write_text('[{"db_id": "a"')
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt"):
        readers.read_questions(spark, str(tmp_path / "broken.json")).collect()


def test_positions_over_parquet_files(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(100).selectExpr("cast(null as string) question_id", "cast(id as string) db_id").repartition(5).write.parquet(path)
    df = readers.read_questions(spark, path, "parquet", with_position=True)
    assert sorted(r["position"] for r in df.collect()) == list(range(100))
    ids = assign_question_id(df)
    assert ids.select("question_id").distinct().count() == 100


def test_read_results_tolerates_corrupt_entries(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    write_json(folder / "1.json", {"question_id": 1, "generation_status": "Success", "execution_match": True, "predicted_exec_status": True})
    write_json(folder / "2.json", {"question_id": 2, "generation_status": "Success", "execution_match": False, "predicted_exec_status": "Failure"})
    (folder / "3.json").write_text('{"question_id": 3, "gen')
    rows = readers.read_results(spark, str(folder), "json").collect()
    by_id = {r["question_id"]: r for r in rows}
    assert by_id["1"]["execution_match"] is True and by_id["2"]["predicted_exec_status"] is False
    assert by_id[None]["_corrupt_record"] is not None
    assert readers.read_results(spark, str(tmp_path / "absent")).count() == 0


def test_splits_and_sources(spark, tmp_path):
    folder = tmp_path / "own"
    folder.mkdir()
    other = readers.resolve_source(spark, None, str(folder), "elsewhere")
    assert other == ("elsewhere", S.PUBLISHED_SPLITS)
    for i, split in enumerate(S.SPLITS):
        write_json(folder / f"{split}.json", [{"question_id": f"{i}{j}", "SQL": "S", "split": "old"} for j in range(i + 1)])
    place, names = readers.resolve_source(spark, None, str(folder), "elsewhere")
    assert place == str(folder)
    df = readers.read_splits(spark, place, names)
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == dict(zip(S.SPLITS, (1, 2, 3)))
    assert df.filter("gold_sql = 'S'").count() == 6
    assert readers.resolve_source(spark, "given", str(folder), "elsewhere")[0] == "given"


def test_discover_databases(spark, tmp_path):
    root = tmp_path / "root"
    spark.range(3).write.parquet(str(root / "shop" / "orders"))
    spark.range(3).coalesce(1).write.parquet(str(root / "bank" / "acct.parquet"))
    (root / "empty").mkdir()
    got = {(r["db_id"], r["table_name"]): r["path"] for r in readers.discover_databases(spark, f"file:{root}").collect()}
    assert set(got) == {("shop", "orders"), ("bank", "acct")}
    again = root / "deep" / str(root).lstrip("/")
    spark.range(2).write.parquet(str(again))
    found = {r["db_id"]: (r["table_name"], r["path"]) for r in readers.discover_databases(spark, str(root)).collect()}
    assert found["deep"] == (str(root).split("/")[1], f"{root}/deep/{str(root).split('/')[1]}")
    assert found["bank"] == ("acct", f"{root}/bank/acct.parquet")
    assert spark.read.parquet(got["bank", "acct"]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.discover_databases(spark, f"file:{root / 'empty'}")


def test_template_and_materialize(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n{nl_question}\n")
    assert readers.load_template(spark, str(tmp_path / "t.txt")) == "a\n{nl_question}\n"
    with pytest.raises(FileNotFoundError):
        readers.load_template(spark, str(tmp_path / "none.txt"))
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    for _ in range(2):
        assert writers.materialize_if_absent(spark, build, str(tmp_path / "once")).count() == 5
    assert len(built) == 1


def test_label_corpus(spark, tmp_path):
    source = write_json(tmp_path / "raw.json", [{"db_id": "a", "SQL": "SELECT 1"}, {"db_id": "a", "SQL": "SELECT a JOIN b"}])
    for _ in range(2):
        df = label_corpus(spark, source, str(tmp_path / "labelled"))
        assert [(r["question_id"], r["level"]) for r in df.orderBy("question_id").collect()] == [("0", S.LEVEL_1), ("1", S.LEVEL_3)]
        (tmp_path / "raw.json").write_text("[]")


def test_append_results_is_first_wins(spark, tmp_path):
    path = str(tmp_path / "results")
    kind = "question_id string, predicted_sql string, generation_status string, extra string"
    writers.append_results(spark.createDataFrame([("1", "a", "Success", "x"), ("2", "b", "Error", "x")], kind), path)
    writers.append_results(spark.createDataFrame([("1", "late", "Success", "x"), ("2", "c", "Success", "x")], kind), path)
    rows = readers.read_results(spark, path)
    assert {r["question_id"]: r["predicted_sql"] for r in rows.collect()} == {"1": "a", "2": "c"}
    assert rows.columns == S.RESULT_FIELDS


def test_appends_that_overlap_store_a_question_once(spark, tmp_path, monkeypatch):
    """While a job is about to commit, two others append; it leaves out what they have stored, and nothing else."""
    path, kind = str(tmp_path / "results"), "question_id string, predicted_sql string, generation_status string"
    rows = lambda name, ids: spark.createDataFrame([(str(i), name, "Success") for i in ids], kind)
    rows("old", range(3)).select("question_id", "predicted_sql", "generation_status").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in S.RESULTS.fields if f"{f.name} " not in kind}).select(S.RESULTS.names).write.parquet(path)
    commit, waiting = Manifest.commit, [("b", range(4, 8)), ("c", range(6, 10))]

    def late(manifest, version, folders):
        while waiting:
            writers.append_results(rows(*waiting.pop()), path)
        return commit(manifest, version, folders)

    monkeypatch.setattr(Manifest, "commit", late)
    writers.append_results(rows("a", range(0, 7)), path)
    got = sorted((int(r["question_id"]), r["predicted_sql"]) for r in readers.read_results(spark, path).collect())
    assert [i for i, _ in got] == list(range(10))
    assert {n for _, n in got} == {"old", "a", "b", "c"} and got[:3] == [(i, "old") for i in range(3)]
    assert not commit(Manifest(spark, path), 1, [])  # taken
    assert Manifest(spark, path).latest()[0] == 3
    # A folder that no version names, as a job leaves it that ends before its commit, does not count.
    readers.read_results(spark, path).write.parquet(f"{path}/rows-lost")
    assert readers.read_results(spark, path).count() == 10


def test_predictions_round_trip(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = [("1", "SELECT 'ä\n\t\"';", "shop"), ("2", "", "bank")]
    writers.write_predictions(spark.createDataFrame(rows, S.PREDICTIONS), path)
    assert sorted(tuple(r) for r in readers.read_predictions(spark, path).collect()) == rows
    whole = write_json(tmp_path / "all.json", {"7": "SELECT 7;\t----- bird -----\tx", "8": "b\t----- bird -----\ty"})
    assert readers.read_predictions(spark, whole, whole=True).count() == 2


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def failing(prompts):
        calls.append(1)
        raise IOError("down")

    with pytest.raises(IOError):
        with_retry(failing, sleep=waits.append)(["p"])
    assert waits == [8, 16, 32, 64] and len(calls) == 5

    def refused(prompts):
        calls.append(1)
        raise ContextLengthExceeded

    calls.clear()
    with pytest.raises(ContextLengthExceeded):
        with_retry(refused, sleep=waits.append)(["p"])
    assert len(calls) == 1


def test_a_failing_batch_leaves_the_others(spark):
    def make():
        def answer(prompts):
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return answer

    df = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c"), ("4", None)], "question_id string, prompt string").coalesce(1)
    got = {r["question_id"]: tuple(r)[1:] for r in generate(df, make, 1, delay=0).collect()}
    assert got == {
        "1": ("A", "Success", None), "2": (None, "Error", "no"), "3": ("C", "Success", None),
        "4": (None, "Error", S.CONTEXT_EXCEEDED),
    }


def test_answers_without_a_statement_are_asked_again(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def make():
        seen = {}

        def answer(prompts):
            with open(calls, "a") as log:
                log.writelines(f"{p}\n" for p in prompts)
            out = []
            for p in prompts:
                seen[p] = seen.get(p, 0) + 1
                out.append("```sql\nSELECT 1\n```" if p == "good" or seen[p] > 2 and p != "never" else "none")
            if "fails once" in prompts and seen["fails once"] == 1:
                raise ValueError("down")
            return out

        return answer

    names = ["good", "third", "never", "fails once"]
    df = spark.createDataFrame([(n, n) for n in names], "question_id string, prompt string").coalesce(1)
    got = {r["question_id"]: r["raw_content"] for r in generate(df, make, 2, attempts=4, delay=0, needs_sql=True).collect()}
    assert got["never"] == "none" and all(got[n].startswith("```") for n in names if n != "never")
    log = open(calls).read().split("\n")
    assert (log.count("good"), log.count("third")) == (1, 3)
    assert generate(df, make, 2, tasks=3).rdd.getNumPartitions() == 3


def logging_model(calls, dies_at=None):
    """A model that notes each prompt it is asked; the worker process ends before its call number ``dies_at``."""

    def make():
        count = []

        def answer(prompts):
            if dies_at is not None and len(count) == dies_at:
                os._exit(7)
            count.append(1)
            with open(calls, "a") as log:
                log.writelines(f"{p}\n" for p in prompts)
            return [f"answer to {p}" for p in prompts]

        return answer

    return make


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    """A worker dies half way; what was told before is in the log, for later runs too."""
    calls, log = str(tmp_path / "calls"), AnswerLog(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([(str(i), f"p{i % 40}") for i in range(60)] + [("none", None)], "question_id string, prompt string")
    with pytest.raises(Exception):
        log.generate(df, logging_model(calls, dies_at=4), batch_size=2, tasks=1)
    before = open(calls).read().split("\n")[:-1]
    assert 0 < len(before) < 40 and log.known().count() == len(before)
    got = {r["question_id"]: tuple(r)[1:] for r in log.generate(df, logging_model(calls), batch_size=2, tasks=2).collect()}
    assert sorted(open(calls).read().split("\n")[:-1]) == sorted(f"p{i}" for i in range(40))  # one call a prompt
    assert got == {**{str(i): (f"answer to p{i % 40}", S.SUCCESS, None) for i in range(60)}, "none": (None, S.ERROR, S.CONTEXT_EXCEEDED)}
    assert log.generate(df, logging_model(calls, dies_at=0), tasks=5).count() == 61  # nothing is left to ask
    more = df.union(spark.createDataFrame([("x", "new")], df.schema))
    assert log.generate(more, logging_model(calls), tasks=3).filter("question_id = 'x'").first()["raw_content"] == "answer to new"


def test_a_restarted_task_reads_its_own_pieces(tmp_path):
    """What Spark does when it runs a task again: the same rows, the same number, another process."""
    calls, asked = [], [pd.DataFrame({"digest": [f"d{i}" for i in range(9)], "prompt": [f"p{i}" for i in range(9)]})]

    def make(fails_at):
        def answer(prompts):
            if len(calls) == fails_at:
                raise KeyboardInterrupt
            calls.append(prompts)
            return [p.upper() for p in prompts]
        return lambda: answer

    run = lambda fails_at, task=3: pd.concat(list(ask_logged(
        iter(asked), make(fails_at), Pieces(f"file:{tmp_path}/x", task), 2, 1, 0, False)))
    with pytest.raises(KeyboardInterrupt):
        run(3)
    got = run(None)
    assert sorted(p for c in calls for p in c) == sorted(f"p{i}" for i in range(9)) and len(calls) == 5
    assert sorted(got["raw_content"]) == sorted(f"P{i}" for i in range(9)) and set(got["generation_status"]) == {S.SUCCESS}
    # A piece that was not finished has another name.
    (tmp_path / "x" / "task=000003" / "000009-cut.part").write_text('{"digest": "d')
    assert len(run(0)) == 9


def test_pieces_on_a_mount_are_one_file_an_attempt(spark, tmp_path):
    """However many batches there are; each is in the file before the next is asked, and a cut line does not count."""
    asked = pd.DataFrame({"digest": [f"d{i}" for i in range(2500)], "prompt": [f"p{i}" for i in range(2500)]})
    folder, seen = tmp_path / "pieces" / "run=1" / "task=000000", []

    def make():
        def answer(prompts):
            seen.append(sum(file.read_text().count("\n") for file in folder.glob("*")) if len(seen) < 5 else None)
            return [p.upper() for p in prompts]
        return answer

    pieces = Pieces(f"file:{tmp_path}/pieces/run=1", 0)
    frames = list(ask_logged(iter([asked]), make, pieces, 1, 1, 0, False))
    assert len(list(folder.glob("*"))) == 1 and seen[:5] == [0, 1, 2, 3, 4] and len(seen) == 2500
    assert [len(frame) for frame in frames] == [1000, 1000, 500]
    (folder / "000001-lost.json").write_text('{"digest": "e0", "raw_content": "E"}\n{"digest": "e1", "raw_con')
    later = Pieces(f"file:{tmp_path}/pieces/run=1", 0)
    later.refresh()
    assert len(later.answers) == 2501 and later.answers["d7"] == "P7" and later.answers["e0"] == "E"
    with open(folder / "000001-lost.json", "a") as file:  # an attempt that still runs
        file.write('tent": "F"}\n')
    later._looked = float("-inf")
    later.refresh()
    assert len(later.answers) == 2502 and later.answers["e1"] == "F"
    (folder / "000002-lost.json").write_text('{"digest": "f0", "raw_content": "cut of')
    known = {r["digest"]: r["raw_content"] for r in AnswerLog(spark, str(tmp_path)).known().collect()}
    assert known == later.answers


def test_pieces_of_a_store_without_additions_are_one_file_a_batch(tmp_path):
    pieces = Pieces(f"file:{tmp_path}/x", 0)
    pieces.files, pieces.folder, pieces._grows = pa_fs.SubTreeFileSystem(str(tmp_path), pa_fs.LocalFileSystem()), "x", False
    for i in range(3):
        pieces.write([(f"d{i}", f"a{i}")])
    assert sorted(p.suffix for p in (tmp_path / "x").iterdir()) == [".json"] * 3
    again = Pieces(f"file:{tmp_path}", 0)
    again.folder = f"{tmp_path}/x"
    again.refresh()
    assert again.answers == {f"d{i}": f"a{i}" for i in range(3)}


def test_errors_are_not_kept(spark, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"))

    def failing():
        def answer(prompts):
            if "bad" in prompts:
                raise ValueError("down")
            return ["good"] * len(prompts)
        return answer

    df = spark.createDataFrame([("1", "bad"), ("2", "fine")], "question_id string, prompt string")
    ask = lambda make: {r["question_id"]: tuple(r)[1:] for r in log.generate(df, make, 1, attempts=2, delay=0, tasks=1).collect()}
    assert ask(failing) == {"1": (None, S.ERROR, "down"), "2": ("good", S.SUCCESS, None)}
    assert ask(lambda: lambda prompts: ["late"] * len(prompts)) == {"1": ("late", S.SUCCESS, None), "2": ("good", S.SUCCESS, None)}


def test_each_prompt_is_sent_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def make():
        def answer(prompts):
            with open(calls, "a") as log:
                log.writelines(f"{p}\n" for p in prompts)
            return ["```sql\nSELECT 1\n```" for _ in prompts]

        return answer

    asked = spark.createDataFrame([(str(i), "d", S.LEVEL_1, f"p{i}") for i in range(30)], "question_id string, db_id string, level string, prompt string")
    runs = asked.select(F.col("question_id").alias("pair_id"), F.lit(True).alias("gold_ok"), F.lit(True).alias("pred_ok"))
    rows = spark.createDataFrame([], "pair_id string, side string, row array<string>")
    checked = verify_candidates(asked.drop("prompt"), generate(asked, make), rows, runs).collect()
    assert len(checked) == 30 and all(r["execution_match"] for r in checked)
    assert sorted(open(calls).read().split()) == sorted(f"p{i}" for i in range(30))


def test_records_are_the_verified_ones(spark):
    fields = "question_id string, db_id string, level string, predicted_sql string, generation_status string, execution_match boolean"
    good = [(str(i), "d", S.LEVEL_1, f"good {i}", "Success", True) for i in range(20)]
    bad = [(str(i), "d", S.LEVEL_1, f"bad {i}", "Success", False) for i in range(40)]
    also = [(str(i), "d", S.LEVEL_1, f"answer {i}", "Success", True) for i in range(20, 40)]
    picked = spark.createDataFrame(
        [(str(i), "d", S.LEVEL_1, "train", "1" if i < 20 else "2") for i in range(40)],
        "question_id string, db_id string, level string, split string, stage string")
    questions = picked.select("question_id", "db_id", "level")
    for results, responses in ((bad[:20] + good, bad + also), (good + bad, also + bad)):
        got = fetch_curated(picked, questions, spark.createDataFrame(results, fields), spark.createDataFrame(responses, fields)).collect()
        assert len(got) == 40 and all(r["execution_match"] for r in got)
        assert {r["question_id"]: r["predicted_sql"] for r in got} == {r[0]: r[3] for r in good + also}


def test_statements_are_kept_inside(spark, workspace, tmp_path):
    (tmp_path / "secret").write_text("x")

    def register(session, db_id):
        session.range(3).withColumnRenamed("id", "my name").createOrReplaceTempView("numbers")

    gold = 'SELECT "my name" FROM numbers'
    wrong = {
        "text": "SELECT 'my name' FROM numbers", "reflect": "SELECT reflect('java.lang.Math', 'abs', 1)",
        "method": "SELECT Java_Method('java.lang.Math', 'abs', 1)", "file": f"SELECT * FROM text.`{tmp_path}/secret`",
        "long": "SELECT " + " + ".join(f"missing_column_{i}" for i in range(300)) + " FROM numbers",
    }
    pairs = spark.createDataFrame(
        [("right", "a", gold, "SELECT `my name` FROM numbers"), *[(k, "a", gold, v) for k, v in wrong.items()]],
        "pair_id string, db_id string, gold_sql string, predicted_sql string")
    rows, runs = execute_pairs(pairs, register, workspace, threads=2)
    got = {r["pair_id"]: r for r in compare_results(rows, runs).collect()}
    assert {k for k, r in got.items() if r["match_status"]} == {"right"}
    assert {k for k, r in got.items() if r["predict_exec_status"]} == {"right", "text"}
    assert "reflection" in got["reflect"]["error_msg"] and "reflection" in got["method"]["error_msg"]
    assert len(got["long"]["error_msg"]) > 1000


def test_execute_pairs(spark, workspace):
    def register(session, db_id):
        session.range(3).withColumnRenamed("id", "n").createOrReplaceTempView("numbers")

    pairs = spark.createDataFrame(
        [
            ("same", "a", "SELECT n FROM numbers", "```sql\nselect n + 0.0 FROM numbers ORDER BY 1 DESC;\n```"),
            ("less", "a", "SELECT n FROM numbers", "SELECT n FROM numbers WHERE n > 0"),
            ("empty", "b", "SELECT n FROM numbers WHERE n > 9", "SELECT n, n FROM numbers WHERE n > 9"),
            ("broken", "b", "SELECT n FROM numbers", "SELECT n FROM nowhere"),
            ("gold", "a", "SELECT x FROM nowhere", "SELECT n FROM numbers"),
            ("write", "a", "SELECT n FROM numbers", "SELECT 1) q; DROP VIEW numbers; SELECT (1"),
            ("none", "a", "SELECT n FROM numbers", None),
        ],
        "pair_id string, db_id string, gold_sql string, predicted_sql string",
    )
    rows, runs = execute_pairs(pairs, register, workspace, threads=4)
    got = {r["pair_id"]: r for r in compare_results(rows, runs).collect()}
    assert {k for k, r in got.items() if r["match_status"]} == {"same", "empty"}
    assert got["less"]["num_predicted_rows"] == 2 and got["less"]["gold_cols"] == ["n"]
    assert got["empty"]["predicted_cols"] == ["n", "n_1"]
    assert not got["broken"]["predict_exec_status"] and got["broken"]["gold_exec_status"] and got["broken"]["error_msg"]
    assert not got["gold"]["gold_exec_status"] and not got["write"]["predict_exec_status"] and not got["none"]["match_status"]


def test_execution_times_out(spark, workspace):
    slow = "SELECT count(*) FROM range(0, 1000000000000, 1, 4) WHERE cast(id AS string) LIKE '%x'"
    pairs = spark.createDataFrame([("p", "a", "SELECT 1", slow)], "pair_id string, db_id string, gold_sql string, predicted_sql string")
    rows, runs = execute_pairs(pairs, lambda session, db_id: None, workspace, timeout=6)
    row = compare_results(rows, runs).first()
    assert row["gold_exec_status"] and not row["predict_exec_status"]
    assert row["error_msg"] == "timed out after 6 seconds"


def test_predict_resumes_and_scores(spark, workspace, tmp_path):
    questions = spark.createDataFrame(
        [(str(i), "a", f"n{i}", None) for i in range(6)], "question_id string, db_id string, question string, evidence string"
    )
    contexts = spark.createDataFrame([("a", "ctx")], "db_id string, context_3 string")

    def maker(broken):
        def make():
            def answer(prompts):
                if broken and any("n3" in p for p in prompts):
                    raise ValueError("down")
                return ["```sql\nSELECT '" + p.split("|")[1] + "'\n```" for p in prompts]

            return answer

        return make

    raw, template = str(tmp_path / "raw"), "{db_schema_context_hmr}|{nl_question}|{hint}"
    first = predict(questions, contexts, template, maker(True), raw, batch_size=1, delay=0)
    assert first.count() == 5
    second = predict(questions, contexts, template, maker(False), raw, batch_size=1)
    assert {r["question_id"]: r["sql"] for r in second.collect()} == {str(i): f"SELECT 'n{i}';" for i in range(6)}
    assert spark.read.schema(S.GENERATIONS).json(raw).count() == 6

    wanted = questions.select("question_id", F.concat(F.lit("SELECT '"), "question", F.lit("'")).alias("gold_sql"))
    pairs = second.join(wanted, "question_id").select(
        F.col("question_id").alias("pair_id"), "db_id", "gold_sql", F.col("sql").alias("predicted_sql")
    )
    rows, runs = execute_pairs(pairs, lambda session, db_id: None, workspace)
    result = score(second, wanted, rows, runs).first()
    assert (result["exact_match_accuracy"], result["execution_accuracy"], result["total_samples"]) == (100, 100, 6)


def test_run_bake(spark, workspace, tmp_path):
    curated = Q.triage.merge_result(Q.labelled(spark, SF_SMALL), Q.results(spark, SF_SMALL)).filter("execution_match")
    path = str(tmp_path / "baked")
    run_bake(
        workspace, curated.withColumn("split", F.lit(S.TRAIN)), Q.catalog(spark, SF_SMALL), Q.samples(spark, SF_SMALL), Q.TEMPLATE, path
    )
    baked = spark.read.parquet(path)
    assert baked.count() == curated.count() and sorted(baked.columns) == sorted(["prompt", "completion", "db_id", "teacher_sql", "split"])


def test_stream_equals_batch_and_replays(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    texts = {str(i): f"```sql\nSELECT {i}\n```" for i in range(30)}
    for part in range(3):
        ids = list(texts)[part * 10 : part * 10 + 10] + (["0", "5"] if part else [])
        lines = [json.dumps({"question_id": q, "raw_content": texts[q] if q not in ("0", "5") or not part else "late"}) for q in ids]
        (source / f"{part}.json").write_text("\n".join(lines))
        stream_ingest(spark, str(source), target, str(tmp_path / "progress")).awaitTermination()
    expected = {q: f"SELECT {q};" for q in texts}
    assert {r["question_id"]: r["sql"] for r in read_ingested(spark, target).collect()} == expected
    # A batch lists and reads the buckets of its own questions only.
    few = list(texts)[:3]
    touched = sorted({r["b"] for r in spark.createDataFrame([(q,) for q in few], "question_id string").select(question_bucket().alias("b")).collect()})
    stored = stored_in(spark, target, touched)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in stored.inputFiles()} == set(touched) and len(touched) <= 3
    assert set(few) <= {r["question_id"] for r in stored.collect()} and stored.count() < 10
    unused = next(b for b in range(256) if f"bucket={b}" not in {p.name for p in (tmp_path / "out").iterdir()})
    assert stored_in(spark, target, [unused]) is None
    again = spark.createDataFrame([(q, texts[q]) for q in list(texts)[10:20]], S.GENERATIONS)
    ingest_batch(again, 1, target)
    ingest_batch(again, 9, target)
    assert sorted((r["question_id"], r["sql"]) for r in read_ingested(spark, target).collect()) == sorted(expected.items())


def test_submission_is_one_object(spark, tmp_path):
    rows = [(str(i), f'SELECT "{{}}" FROM t{i} -- }}\n', f"db{i}") for i in range(40)] + [('q"uote', "SELECT '}'", "d")]
    frame = spark.createDataFrame(rows, "question_id string, sql string, db_id string").repartition(5)
    path = str(tmp_path / "submission")
    writers.write_submission(frame, path, parts=1)
    parts = [p for p in (tmp_path / "submission").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1
    assert json.loads(parts[0].read_text()) == {q: f"{sql}{S.PREDICTION_SEPARATOR}{db}" for q, sql, db in rows}
    assert readers.read_predictions(spark, path, whole=True).count() == readers.read_submission(spark, path).count() == 41
    writers.write_submission(frame.limit(0), path)
    assert json.loads(next(p for p in (tmp_path / "submission").iterdir() if p.name.startswith("part-")).read_text()) == {}
    assert readers.read_submission(spark, path).count() == 0
    # Many files behind each other, in the order of their names, are the same object.
    writers.write_submission(frame, path, parts=6)
    parts = sorted(p for p in (tmp_path / "submission").iterdir() if p.name.startswith("part-"))
    assert len(parts) == 6
    assert json.loads("".join(p.read_text() for p in parts)) == {q: f"{sql}{S.PREDICTION_SEPARATOR}{db}" for q, sql, db in rows}
    assert sorted(tuple(r) for r in readers.read_submission(spark, path).collect()) == sorted(rows)
    writers.write_submission(frame.filter("question_id = '7'"), path)
    assert readers.read_submission(spark, path).first()["db_id"] == "db7"


def test_thousands_of_tables_are_one_job(spark, tmp_path):
    """2,000 tables, each with a column of its own; the driver plans no read for any of them."""
    root = tmp_path / "many"
    for i in range(2000):
        place = root / f"db{i % 50}"
        place.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({f"c{i}": [i, i + 1, i + 2, i + 3], "b": [b"x"] * 4}), place / f"t{i}.parquet")
    tables = readers.discover_databases(spark, str(root))
    found = C.sample_databases(spark, tables, 2, tasks=8)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "parquet" not in text.lower().replace("*.parquet", "").split("mapinarrow")[0]
    rows = found.collect()
    assert len(rows) == 4000
    assert all(r["header"] == [f"c{r['table_name'][1:]}"] and r["cells"] == [str(int(r["table_name"][1:]) + r["row_no"] - 1)] for r in rows)


def test_sampled_cells_read_like_cells_of_a_query(spark, tmp_path):
    """Whatever its type, a cell is written as Spark writes it."""
    row = ("'text'", "cast(1.5 as double) r", "cast(1e20 as double) big", "cast(0.1 as float) f", "cast(3.10 as decimal(9,2)) dec", "true flag",
           "cast(7 as tinyint) tiny", "date'2020-02-29' day", "timestamp'2021-03-04 05:06:07.120' at", "timestamp_ntz'2021-03-04 05:06:07' ntz",
           "array(1, null, 3) list", "named_struct('a', 1, 'b', 'x') pair", "map('k', 2) held", "cast(null as string) none", "repeat('y', 80) long")
    df = spark.range(3).selectExpr("id", *row)
    df.repartitionByRange(2, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "r" / "db" / "t"))
    got = C.sample_databases(spark, readers.discover_databases(spark, str(tmp_path / "r")), 5).orderBy("row_no").collect()
    want = df.select(C.sample_cells(df, df.columns).alias("cells")).orderBy("id").collect()
    assert [r["cells"] for r in got] == [r["cells"] for r in want] and got[0]["header"] == df.columns


def test_samples_by_table_name(spark, workspace, tmp_path):
    root = tmp_path / "root"
    spark.range(5).withColumn("photo", F.lit("x").cast("binary")).coalesce(1).write.parquet(str(root / "shop" / "Orders"))
    (root / "shop" / "bad.parquet").write_text("no table")
    found = C.sample_databases(spark, readers.discover_databases(spark, str(root)), 2)
    assert [(r["table_name"], r["row_no"], r["header"], r["cells"]) for r in found.orderBy("row_no").collect()] == [
        ("Orders", 1, ["id"], ["0"]), ("Orders", 2, ["id"], ["1"])]
    entry = ("shop", ["customers", "orders"])
    catalog = spark.createDataFrame([entry], "db_id string, table_names_original array<string>")
    assert {tuple(r) for r in C.number_samples(found, catalog).select("db_id", "table_idx", "row_no").collect()} == {("shop", 1, 1), ("shop", 1, 2)}


def test_curation_asks_a_model(spark, workspace, tmp_path):
    questions, known = Q.labelled(spark, SF_SMALL), workspace.table(Q.responses(spark, SF_SMALL), "responses")
    calls = []

    def verify(rows):
        calls.append(workspace.table(rows, "asked"))
        return calls[-1].join(known, "question_id").withColumn("predicted_sql", F.concat(F.lit("SELECT "), "question_id"))

    settings = Settings(train_size=300, val_in_size=8, val_out_size=8)
    path, stored = str(tmp_path / "curated"), str(tmp_path / "results")
    text = run_curation(workspace, questions, Q.results(spark, SF_SMALL), None, path, settings, verify, stored)
    want = curate(workspace, questions, Q.results(spark, SF_SMALL), known, settings)
    rows = readers.read_curated(spark, path)
    assert {(r["question_id"], r["split"]) for r in rows.collect()} == {(r["question_id"], r["split"]) for r in want.collect()}
    assert rows.filter("NOT execution_match OR predicted_sql IS NULL").count() == 0
    asked = [r["question_id"] for call in calls for r in call.collect()]
    candidates = Q.triaged(spark, SF_SMALL).filter("cache_state = 'candidate'").count()
    assert len(asked) == len(set(asked)) and 0 < len(asked) < candidates
    assert "## After stage 2" in text and "with rows" in text
    assert {r["question_id"] for r in readers.read_results(spark, stored).collect()} <= set(asked)
