import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sqlcorpus.llm import embed, pack, toxicity
from sqlcorpus.llm.embed import fit_index, near_vectors, unit
from sqlcorpus.llm.pack import cut_pieces, pack_documents, pack_lengths, sum_of_squares
from sqlcorpus.llm.queries import LEARNED, op4_best_fit_packing, op6_embedding_near_dedup, op8_toxicity, tokenizer_path
from sqlcorpus.llm.toxicity import ToxicityModel, ToxicitySettings, WordCoder, keep_clean, score_toxicity, train_toxicity

SF = "/root/testdata/sf0.001"


def check_packed(rows, size, lengths):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    want = sorted((k, i, s, n) for k, total in lengths for i, (s, n) in enumerate(cut_pieces(total, size)))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == want
    return len(by)


def test_sum_of_squares_by_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(30):
        size = int(rng.integers(2, 30))
        lengths = rng.integers(1, size + 1, 80)
        bins = sum_of_squares(lengths, size)
        fill: dict[int, int] = {}
        for s, b in zip(lengths.tolist(), bins.tolist()):
            def cost(number, gap):
                gaps = [size - v for k, v in fill.items() if k != number and v < size] + ([gap - s] if gap > s else [])
                return sum(c * c for c in np.bincount(gaps).tolist()) if gaps else 0
            options = [cost(k, size - v) for k, v in fill.items() if size - v >= s] + [cost(None, size)]
            assert cost(b if b in fill else None, size - fill.get(b, 0)) == min(options)
            fill[b] = fill.get(b, 0) + s
        assert max(fill.values()) <= size
        tight = pack_lengths(lengths, size)
        assert np.bincount(tight, weights=lengths).max() <= size and len(set(tight)) <= len(fill)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0]
           for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_best_fit_packing(spark, SF).collect()
    n = check_packed(rows, 2048, [(k, len(v)) for k, v in ids.items()])
    assert n <= 1.02 * sum(map(len, ids.values())) / 2048 + 2
    for r in rows:
        part = pa.array(ids[r.doc_id][r.start:r.start + r.length], pa.uint32()).buffers()[1].to_pybytes()[:4 * r.length]
        assert r.ids_crc32 == zlib.crc32(part)


def test_packing_odd_rows(spark, workspace, monkeypatch):
    monkeypatch.setattr(pack, "GROUP_PIECES", 3)
    rows = [(1, None), (2, ""), (3, "word " * 30), (4, "word " * 31 + "<|endoftext|>"), (5, "word")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("x")).withColumn("_group", F.lit(0))
    got = pack_documents(frame, workspace, tokenizer_path("byte_bpe_50k.json"), size=8, ids=True).collect()
    assert all(len(r.ids) == 4 * r.length for r in got)
    joined = {k: b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)) for k in (1, 4)}
    assert joined[1] == b"\0" * 4 and len(joined[4]) % 4 == 0
    check_packed(got, 8, [(k, sum(r.length for r in got if r.doc_id == k)) for k in range(1, 6)])
    again = frame.unionByName(frame).unionByName(frame.withColumn("doc_id", F.lit(None).cast("long")))
    assert pack_documents(again, workspace, tokenizer_path("byte_bpe_50k.json")).count() == 15
    assert pack_documents(frame.limit(0), workspace, tokenizer_path("byte_bpe_50k.json")).count() == 0


def plain_links(rows, threshold):
    good = {i: np.array(v, dtype=float) for i, v, l in rows}
    usable = {i for i, v, l in rows if l is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()
              and np.any(np.array(v, dtype=float) != 0)}
    label, links = {i: l for i, v, l in rows}, defaultdict(set)
    for a in usable:
        for b in usable:
            if a < b and label[a] == label[b] and len(good[a]) == len(good[b]):
                x, y = good[a] / np.abs(good[a]).max(), good[b] / np.abs(good[b]).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    root = {i: i for i, _, _ in rows}
    for _ in rows:
        for a, bs in links.items():
            for b in bs:
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(links[i]), root[i], root[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("homes,queries", [(1024, 2048), (5, 7)])
def test_vectors(spark, workspace, monkeypatch, homes, queries):
    monkeypatch.setattr(embed, "BLOCK_HOMES", homes)
    monkeypatch.setattr(embed, "BLOCK_QUERIES", queries)
    rng, rows = np.random.default_rng(1), []
    for _ in range(25):
        center = rng.normal(size=8)
        for _ in range(rng.integers(1, 25)):
            rows.append([rng.choice([0.2, 1, 3]) * (center + rng.normal(size=8) * 0.12), int(rng.integers(0, 2))])
    rows = [[list(map(float, v)), l] for v, l in rows]
    rows += [list(rows[3]), list(rows[3]), [[0.0] * 8, 0], [None, 0], [[1.0] * 7 + [None], 0], [[float("nan")] * 8, 1],
             [[float("inf")] + [1.0] * 7, 1], [rows[0][0], None], [[1e200] * 8, 0], [[1.0] * 8, 0]]
    rows = [(i, v, l) for i, (v, l) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("_v", F.lit(1)).withColumn("kept", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame, workspace).collect()}
    assert got == plain_links(rows, 0.93)
    assert near_vectors(frame.limit(0), workspace).count() == 0


def test_lengths_are_labels_of_their_own(spark, workspace, monkeypatch):
    """Vectors of a rarer length link with each other, through an index if they are many, and with no other length."""
    rng = np.random.default_rng(4)
    rows = []
    for d, n in ((8, 300), (4, 120), (5, 40), (1, 6), (12, 2)):
        base = rng.normal(size=(n // 2, d))
        rows += [[v.tolist(), int(i % 3)] for i, v in enumerate(np.concatenate([base, base + 0.05 * rng.normal(size=base.shape)]))]
    rows += [[rows[300][0], rows[300][1]], [rows[300][0], 2], [[1.0] * 4 + [0.0] * 4, 1], [[1.0] * 4, 1], [[], 1]]
    rows = [(i, v, l) for i, (v, l) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("a.b", F.lit(1))
    want = plain_links(rows, 0.93)
    assert sum(links for links, *_ in want.values()) > 300
    for many in (1024, 50):
        monkeypatch.setattr(embed, "BLOCK_HOMES", many)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame, workspace).collect()}
        assert got == want


def test_index_recall():
    rng = np.random.default_rng(2)
    base = unit(rng.normal(size=(6000, 32)))
    index = fit_index(base, 200_000, 0.93)
    noise = rng.normal(size=(500, 32))
    noise -= (noise * base[:500]).sum(1, keepdims=True) * base[:500]
    queries = unit(0.95 * base[:500] + (1 - 0.95 ** 2) ** 0.5 * unit(noise))
    home, walk = index.order(base[:500], 1)[:, 0], index.order(queries, index.visits)
    assert (walk == home[:, None]).any(1).mean() >= 0.9
    cut = 16
    d = ((queries[:, None, :cut] - index.halves[0][None]) ** 2).sum(2)[:, :, None] + (
        (queries[:, None, cut:] - index.halves[1][None]) ** 2).sum(2)[:, None, :]
    flat = np.sort(d.reshape(len(queries), -1), axis=1)[:, :index.visits]
    assert np.allclose(np.sort(np.take_along_axis(d.reshape(len(queries), -1), walk, 1), axis=1), flat)


def test_vector_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op6_embedding_near_dedup(spark, SF).collect()}
    assert got == plain_links(rows, 0.93)


def test_toxicity(spark):
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilest", "rotten", "zzkid" + rng.choice(["en", "s", "ly"])]))
        rows.append((i, " ".join(text), "xy"[i % 2]))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None), (1001, "", "x"), (None, "vilest", "x"), (5, rows[5][1], "x"), (1002, "clean " * 60_000 + "vilest", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    model = train_toxicity(frame, marks, ToxicitySettings(max_train=600), keep=LEARNED)
    got = score_toxicity(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[1002].score >= 0.5 and by[None].score >= 0.5 and by[1001].score < 0.5
    kept = keep_clean(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(not r.flagged for r in got)
    assert score_toxicity(frame.limit(0), model).count() == 0
    none = train_toxicity(frame, marks.limit(0))
    assert all(r.score < 0.5 for r in score_toxicity(frame, none).collect())
    other = frame.withColumn("lang", F.lit("q")).withColumn("doc_id", F.col("doc_id") + 5)
    assert {r.doc_id + 5: r.score for r in got if r.doc_id} == {r.doc_id: r.score for r in score_toxicity(other, model).collect() if r.doc_id and r.doc_id != 5}


def test_toxicity_of_a_text_ignores_its_neighbours():
    rng = np.random.default_rng(0)
    model = random_model(rng)
    coder = WordCoder(model.settings.buckets)
    clean, toxic, empty = coder("fine words only"), coder("vilest text of all"), coder("")
    model.embedding[toxic[0]] = 3 * rng.normal(size=(3, model.settings.size))
    for text in (clean, empty):
        alone = model.pooled([text])[0]
        for texts, k in (([toxic, text], 1), ([text, toxic], 0), ([clean, text, toxic, empty, toxic], 1)):
            assert np.allclose(model.pooled(texts)[k], alone, atol=1e-5)
    h, codes, places = model.pooled([clean, toxic, empty, toxic, clean], trace=True)
    starts = np.cumsum([0] + [len(t) + 3 for t in (clean, toxic, empty, toxic)])
    for width, place in zip(model.settings.widths, places):
        assert (place >= starts[:, None]).all() and (place[:-1] + width <= starts[1:, None]).all()


def random_model(rng):
    s = ToxicitySettings()
    k = len(s.widths) * s.filters
    embedding = rng.normal(size=(s.buckets, s.size)).astype(np.float32)
    embedding[0] = 0
    filters = [rng.normal(size=(w, s.size, s.filters)).astype(np.float32) for w in s.widths]
    return ToxicityModel(s, embedding, filters, [np.zeros(s.filters, dtype=np.float32) for _ in s.widths],
                         rng.normal(size=k).astype(np.float32), 0.0)


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) + " vilest" * (i % 3 == 0), "x") for i in range(600)]
    # A rare language of long texts only, none of which may be fitted.
    rows += [(1000 + i, "good " * 400 + "vilest " * (i % 2), "rare") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int("vilest" in t)) for i, t, _ in rows], "doc_id long, toxic int")
    counted = []
    plain = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda model, counts: counted.extend(counts) or plain(model, counts))
    model = train_toxicity(frame, marks, ToxicitySettings(max_train=60, max_words=300))
    assert sum(n for *_, n in counted) == len(rows)
    assert {(lang, y): sum(n for l, k, _, n in counted if (l, k) == (lang, y)) for lang in ("x", "rare") for y in (0, 1)} == {
        ("x", 0): 400, ("x", 1): 200, ("rare", 0): 10, ("rare", 1): 10}
    assert set(model.thresholds) == {"x", "rare"} and model.thresholds["rare"] != 0.5
    flagged = {r.doc_id: r.flagged for r in score_toxicity(frame, model).collect()}
    assert all(flagged[1000 + i] == (i % 2 == 1) for i in range(20))


def test_cuts_from_counts():
    rng = np.random.default_rng(4)
    for _ in range(50):
        z = np.unique(rng.integers(0, 30, 12)).astype(float)
        toxic, clean = rng.integers(0, 4, len(z)), rng.integers(0, 4, len(z))
        at = toxicity.best_cut(z, toxic, clean)

        def error(c):
            return toxic[z < c].sum() / max(1, toxic.sum()) + clean[z >= c].sum() / max(1, clean.sum())
        assert error(at) <= min(error(c) for c in np.arange(-1.5, 31)) + 1e-9


def test_toxicity_held_out(spark):
    """Over the largest sample of the small tables."""
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op8_toxicity(spark, folder).where("held_out").collect() if r.doc_id in truth]
    toxic = [r.score for r in rows if truth[r.doc_id]]
    clean = [r.score for r in rows if not truth[r.doc_id]]
    auc = np.mean([(t > np.array(clean)).mean() for t in toxic])
    assert auc >= 0.95 and np.mean([r.predicted == truth[r.doc_id] for r in rows]) >= 0.95
