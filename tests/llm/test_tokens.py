import hashlib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sqlcorpus.llm import bpe
from sqlcorpus.llm.bpe import ChunkCodec, content_cuts
from sqlcorpus.llm.queries import op7_bpe_round_trip, op9_token_counts, tokenizer_path
from sqlcorpus.llm.tokens import TokenCounter, count_tokens, encode_texts

SF = "/root/testdata/sf0.001"
ALPHABET = [*"aZbéÉßŉİıſΣσς \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​　.,!?;:'\"#&<|>_-0159²½Ⅷ漢字🙂́̈\x00",
            "the ", " of", "'s", "'ll", "'LL", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", "word, ", "ing"]


def odd_texts(n=1500):
    rng = random.Random(5)
    out = ["", " ", "\n", "a", "<|endoftext|>", "x" * 5000, " " * 3000, "ab " * 4000, "é", "Σας ΟΔΟΣ"]
    for _ in range(n):
        out.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, rng.choice([5, 40, 900])))))
    return out


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_chunks_encode_like_the_library_and_decode():
    path, t = tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    codec = ChunkCodec(path)
    texts = odd_texts()
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(text)
        assert memoryview(ids).cast("I").tolist() == want.ids
        assert codec.decode(ids) == t.decode(want.ids, skip_special_tokens=False) == text


def test_cuts_follow_content():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    a, b = "prefix" * 9 + shared, shared
    moved = {x - 54 for x in content_cuts(a)}
    assert {x for x in content_cuts(b) if x > 16} <= moved
    codec = ChunkCodec(tokenizer_path("byte_bpe_50k.json"))
    codec.encode(a)
    codec.encode(b)
    assert codec.reused > 10


def test_counts_like_the_library():
    path, t = tokenizer_path("word_bpe_49k.json"), library("word_bpe_49k.json")
    counter = TokenCounter(path)
    texts = odd_texts()
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(text.encode()) == len(want.ids), repr(text)
    assert counter.whole > 20_000


@pytest.fixture
def odd_docs(spark):
    rows = [(1, None), (1, ""), (2, "the word"), (None, "the word"), (3, "long " * 50_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))


def test_odd_rows(spark, odd_docs):
    got = encode_texts(odd_docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or 0, r.decoded[:9], len(r.ids) > 0) for r in got) == [
        (0, "the word", True), (1, "", False), (1, "", False), (2, "the word", True), (3, "long long", True)]
    counted = count_tokens(odd_docs, tokenizer_path("word_bpe_49k.json"), limit=2).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == [
        (0, 8, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 8, 2, False), (3, 250_000, 50_000, True)]
    empty = odd_docs.limit(0)
    assert encode_texts(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert count_tokens(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_queries_against_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    t, w = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    for r in op7_bpe_round_trip(spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(pa.array(ids, pa.uint32()).buffers()[1].to_pybytes()[:4 * len(ids)]
                                              if ids else b"").hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in op9_token_counts(spark, SF).collect():
        assert r.n_tokens == len(w.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)


def test_vocabularies_with_another_pattern_are_refused(tmp_path):
    byte, word = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        ChunkCodec(word)
    with pytest.raises(ValueError):
        TokenCounter(byte, [])
    changed = json.loads(open(byte).read())
    changed["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(changed))
    with pytest.raises(ValueError):
        ChunkCodec(str(tmp_path / "other.json"))


def test_old_chunks_are_dropped_singly(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 50)
    codec, whole = ChunkCodec(tokenizer_path("byte_bpe_50k.json")), ChunkCodec(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(400)) for _ in range(20)]
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 50)
    for t in texts + texts:
        assert codec.encode(t) == whole.pieces.plain(t)
    assert len(codec.chunks) == 50 and codec.seen > codec.reused >= 0
