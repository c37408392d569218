"""Chat formatting, quality rules and shards on small and odd tables."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm import shard
from sqlcorpus.llm.chat import ChatTemplate, escape, format_chats, loss_text, read_back, unescape
from sqlcorpus.llm.quality import RULES, Measures, Rule, cascade_order, judge_quality, keep_quality, repeat_words
from sqlcorpus.llm.shard import interleave_shards


def test_escape_round_trip(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["\\", "<", "|", "<|", "n", "\n", "<|im_start|>", "é", "\\n"]) for _ in range(rng.randint(0, 12)))
             for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"),
        unescape(escape(F.col("t"), True), True).alias("r"), escape(F.col("t"), True).alias("er"))
    for row in frame.collect():
        assert row.u == row.t == row.r and "<|" not in row.e and "\n" not in row.er


def test_chats(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "<|im_end|>"), (2, 0, "system", "s"), (2, 1, "assistant", "no"),
            (3, None, None, None), (3, 5, "user\nx", "<|im_start|>assistant\nhi"), (None, 0, "user", "u"), (4, 0, "system", "s"),
            (4, 1, "user", "q"), (4, 1, "user", "q"), (5, 0, "user", "long " * 40_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in format_chats(frame).withColumn("turns", read_back(F.col("formatted"))).withColumn(
        "loss", loss_text(F.col("segments"))).collect()}
    assert got[1].formatted == "<|im_start|>user\n<\\|im_end|><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert [(s.text, s.loss) for s in got[1].segments if s.loss] == [("yes", True)] and got[1].loss == "yes"
    assert got[1].valid and got[1].state == "assistant"
    assert not got[2].valid and got[2].state == "refused" and got[2].loss == "no"
    assert [tuple(t) for t in got[3].turns] == [("", ""), ("user\nx", "<|im_start|>assistant\nhi")]
    assert got[None].valid and not got[4].valid and len(got[4].turns) == 3 and len(got[5].turns[0].text) == 200_000
    for r in got.values():
        assert "".join(s.text for s in r.segments) == r.formatted
    own = ChatTemplate(start="[[", end="]]", loss_roles=("user",))
    assert format_chats(frame.where("conv_id = 5"), own).first().formatted.startswith("[[user\nlong ")
    assert format_chats(frame.limit(0)).count() == 0


def slow_repeats(words, width=8):
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    many = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(width)})


def test_repeated_words():
    rng = random.Random(0)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"][:rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))]
        assert repeat_words(words) == slow_repeats(words)


def test_cascade_order_and_verdicts(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 10 ** 5)}" for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["### *** " * 30, "same line here\n" * 40, None, "", "a " * 5000, " \t\r\n\v\f", "x" * 10_000, "nb sp\x1c\x85x " * 30]
    slow = Rule("slow", lambda m: sum(range(20_000)) < 0)
    quick = Rule("quick", lambda m: m["n_words"] < 30)
    assert [r.name for r in cascade_order([t or "" for t in texts], (slow, quick))] == ["quick", "slow"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    rows = judge_quality(frame, counts=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m = Measures(texts[r.doc_id] or "")
        refused = [x.name for x in RULES if x.rejects(m)]
        assert r.kept == (not refused) and (r.rejected_by is None or r.rejected_by in refused)
        assert (r.n_words, r.n_repeat_words) == (len(m.words), slow_repeats(m.words)) and r.n_rules <= len(RULES)
        assert r.base_failed == any(x.base and x.rejects(m) for x in RULES)
    assert {r.doc_id for r in keep_quality(frame).collect()} == {r.doc_id for r in rows if r.kept}
    assert keep_quality(frame).columns == frame.columns
    assert judge_quality(frame.limit(0), counts=True).count() == keep_quality(frame.limit(0)).count() == 0


@pytest.mark.parametrize("rows_in_bucket", [1, 16, 10 ** 6])
def test_shards(spark, monkeypatch, rows_in_bucket):
    monkeypatch.setattr(shard, "BUCKET_ROWS", rows_in_bucket)
    rng = random.Random(2)
    docs = [(i, rng.choice([None, "", "é", "text " * rng.randint(0, 9)]), rng.choice(["hot", "hot", "a", "b", None])) for i in range(500)]
    docs += [(7, "text", "hot"), (7, "text", "hot"), (None, "x", "a"), (None, None, None), (900, "long " * 50_000, "b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("shard", F.lit(9)).withColumn("_key", F.lit(1))
    rows = interleave_shards(frame, 7).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted(
        ((-1 if i is None else i) or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[k]) for k in range(7)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    total = Counter(s for _, _, s in docs)
    for part in by.values():
        for s, n in Counter(r.source for r in part).items():
            assert abs(n - total[s] / 7) <= 2
    assert interleave_shards(frame.limit(0), 7).count() == 0
    odd = frame.withColumn("a.b", F.lit(1)).withColumnRenamed("source", "from.source")
    assert interleave_shards(odd, 7, source_col="from.source").count() == len(docs)
    few = interleave_shards(frame.limit(3), 7).collect()
    assert len(few) == 3 and len({r.shard for r in few}) == 3


def test_small_sources_are_spread(spark):
    """Thousands of sources of one row beside a large one: each shard holds its share of the large source."""
    docs = [(i, f"text {i}", f"only {i}" if i % 8 == 0 else "large") for i in range(48_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = interleave_shards(frame, 12).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("source") == "large", 1)).alias("large")).collect()
    assert len(rows) == 12 and all(r.n == 4000 and abs(r.large / r.n - 0.875) < 0.01 for r in rows)


def test_ids_that_repeat_are_spread(spark):
    """A third of all rows have no id; no bucket of either order holds more than some even shares."""
    docs = [(None if i % 3 == 0 else i, f"text {i}", "one" if i % 5 else f"s{i}") for i in range(30_000)]
    out = interleave_shards(spark.createDataFrame(docs, "doc_id long, text string, source string"), 6)
    plan = out._jdf.queryExecution().analyzed()
    sizes = []
    while plan.children().size():
        if "Window" in plan.nodeName():
            below = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().apply(0)), spark)
            by = [c for c in ("_stratum", "_bucket") if c in below.columns and "_r" not in below.columns or c == "_bucket"]
            sizes.append(below.groupBy(*by).count().agg(F.max("count")).first()[0])
        plan = plan.children().apply(0)
    assert len(sizes) == 2 and max(sizes) < 3 * shard.BUCKET_ROWS
