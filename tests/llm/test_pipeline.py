"""The whole pipeline and its stages against plain versions."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from sqlcorpus.llm.pack import cut_pieces
from sqlcorpus.llm.quality import RULES, Measures
from sqlcorpus.llm.queries import LLM_QUERIES, tokenizer_path
from sqlcorpus.llm.suffix import whole_characters
from sqlcorpus.llm.toxicity import scorer, train_toxicity

from .test_minhash import plain_classes
from .test_suffix import plain_removal

SF = "/root/testdata/sf0.001"


def plain_stages(spark, docs):
    """The documents that each stage but the last should leave, as {id: text}."""
    kept = {k: t for k, t in docs.items() if not any(r.rejects(Measures(t or "")) for r in RULES)}
    yield kept
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    frame = frame.where(frame.doc_id.isin(list(kept)))
    langs = {r.doc_id: r.lang for r in frame.collect()}
    judge = scorer(train_toxicity(frame, spark.read.parquet(f"{SF}/labels.parquet"), keep=P.LEARNED))
    kept = {k: t for k, t in kept.items() if not judge([t], [langs[k]])[1][0]}
    yield kept
    classes = plain_classes(list(kept.items()))
    kept = {k: t for k, t in kept.items() if classes[k] == k}
    yield kept
    found = plain_removal([(k, (t or "").encode()) for k, t in kept.items()])
    kept = {}
    for k, (mask, text) in found.items():
        raw = np.frombuffer(text, dtype=np.uint8)
        kept[k] = raw[~whole_characters(raw, mask)].tobytes().decode()
    yield kept


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, docs = frame.columns, {r.doc_id: r.text for r in frame.collect()}
    want = list(plain_stages(spark, docs))
    assert [len(w) for w in want] == sorted((len(w) for w in want), reverse=True) and len(want[2]) < len(docs)
    for number, (name, stage) in enumerate(P.STAGES[:-1]):
        frame = stage(spark, frame, SF)
        frame.write.parquet(f"{tmp_path}/{number}")
        frame = spark.read.parquet(f"{tmp_path}/{number}")
        assert frame.columns == columns, name
        rows = frame.collect()
        assert {r.doc_id: r.text for r in rows} == want[number], name
        if number == 3:
            assert all(r.n_chars == len(r.text) for r in rows)
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows, by = P.run(spark, SF).collect(), defaultdict(int)
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == sorted(
        (k, i, s, n) for k, text in want[-1].items()
        for i, (s, n) in enumerate(cut_pieces(len(t.encode(text, add_special_tokens=False).ids) + 1, 2048)))
    for r in rows:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 2048


def test_odd_documents(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    text = "a text of quite some words that says nothing in particular but goes on for a while so that it is long enough to stay"
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, text, None, None, None, "b"), (4, text, "en", "s", 1, "c"),
            (None, text, "en", None, 1, "d"), (5, "other " + text[::-1] + " ".join(f"é{i}" for i in range(40)), "xx", "s", 1, "e"), (3, text, None, None, None, "b")]
    labels = spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs, want in (("some", rows, {0, 3, 5}), ("none", [], set())):
        docs = spark.createDataFrame(docs, kind).withColumn("a.b", F.lit("dot")).withColumn("rest", F.lit(1)).withColumn("_text", F.lit(2))
        columns = docs.columns
        for number, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert number == 4 or docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{name}{number}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{number}")
        assert {r.doc_id or 0 for r in docs.collect()} == want


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in LLM_QUERIES} == set(range(1, 14))
    assert len(P.STAGES) == 5
