"""The shared folder, and tables kept in it."""

from types import SimpleNamespace

import pytest

from sqlcorpus.session import Workspace, first_characters, path_exists, shared_folder


def session(master, folder=None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=settings.get), sparkContext=SimpleNamespace(master=master))


def test_the_cluster_names_the_folder():
    assert shared_folder(session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(session("local[2]", "/given")) == "/given"
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))


def test_a_local_session_gets_one_folder():
    assert shared_folder(session("local[2]")) == shared_folder(session("local[4]"))


def test_tables_are_kept_apart_and_deleted(spark):
    workspace = Workspace(spark)
    first, second = workspace.table(spark.range(3), "t"), workspace.table(spark.range(5), "t")
    assert (first.count(), second.count()) == (3, 5)
    assert first.rdd.getNumPartitions() >= 1 and path_exists(spark, workspace.root)
    workspace.close()
    assert not path_exists(spark, workspace.root)


def test_first_character(spark, tmp_path):
    (tmp_path / "a.json").write_text("\ufeff \n [1]", encoding="utf-8")
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text(" " * 6000 + "{}")
    assert [c for _, c in first_characters(spark, str(tmp_path / "a.json"))] == ["["]
    assert [c for _, c in first_characters(spark, str(tmp_path / "b.json"))] == [""]
    assert [c for _, c in first_characters(spark, str(tmp_path))] == ["[", "", "{"]
