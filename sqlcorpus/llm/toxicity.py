"""Toxicity by a small convolutional classifier: hashed word embeddings, filters of several widths, max pooling."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import keep_rows, per_batch

#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

#: Bins of log odds in which labelled rows are counted to find cuts.
BINS = 1 << 14


@dataclass(frozen=True)
class ToxicitySettings:
    """``max_train`` rows at most are fitted, half of them toxic where there are enough, none over ``max_words``."""

    max_train: int = 6000
    max_words: int = 6000
    buckets: int = 1 << 15
    size: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    least_rows: int = 3
    epochs: int = 12
    rate: float = 0.01
    seed: int = 11


class WordCoder(dict):
    """Three hash buckets for every word of a text: the word's and those of its first four and five bytes.

    Inflected forms that no fitted row holds so share what their stem has learned. Words are remembered up to a bound.
    """

    LIMIT = 400_000

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets
        self.rows = np.zeros((4096, 3), dtype=np.int32)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = [zlib.crc32(x) % (self.buckets - 1) + 1 for x in (word, b"4" + word[:4], b"5" + word[:5])]
        return k

    def __call__(self, text: str) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        words = text.lower().encode("utf-8").translate(_LETTERS).split()
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.rows[ids]


@dataclass
class ToxicityModel:
    """Parameters, an offset that puts the best cut of all labelled rows at 0.5, and a threshold for each language."""

    settings: ToxicitySettings
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    intercept: float
    offset: float = 0.0
    scale: float = 1.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, texts: list[np.ndarray], trace: bool = False):
        """Largest response of each filter in each text, and with ``trace`` the places of those responses."""
        gap = max(self.settings.widths)
        pad = np.zeros((gap, 3), dtype=np.int32)
        codes = np.concatenate([x for t in texts for x in (t, pad)])
        starts = np.concatenate([[0], np.cumsum([len(t) + gap for t in texts])])
        x, out, places = sum(self.embedding[codes[:, i]] for i in range(3)), [], []
        for width, w, b in zip(self.settings.widths, self.filters, self.bias):
            n = len(codes) - width + 1
            y = x[:n] @ w[0]
            for i in range(1, width):
                y += x[i:n + i] @ w[i]
            # Windows from a text's last gap rows on reach into the next text and belong to neither.
            y[(starts[1:-1, None] - np.arange(1, width)).ravel()] = -np.inf
            best = np.maximum.reduceat(y, starts[:-1], axis=0)
            out.append(best + b)
            if trace:
                at = np.empty(best.shape, dtype=np.int64)
                for k, (s, e) in enumerate(zip(starts[:-1], np.minimum(starts[1:], n))):
                    at[k] = s + y[s:e].argmax(axis=0)
                places.append(at)
        h = np.concatenate(out, axis=1)
        return (h, codes, places) if trace else h

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log odds; texts go in runs of bounded length, a long text in overlapping runs whose maxima are joined."""
        limit, overlap = 100_000, max(self.settings.widths) - 1
        parts, owner = [], []
        for k, t in enumerate(texts):
            for s in range(0, max(1, len(t) - overlap), limit):
                parts.append(t[s:s + limit + overlap])
                owner.append(k)
        h = np.full((len(texts), len(self.weights)), -np.inf, dtype=np.float32)
        start = 0
        while start < len(parts):
            end, held = start, 0
            while end < len(parts) and (end == start or held + len(parts[end]) <= limit):
                held += len(parts[end])
                end += 1
            np.maximum.at(h, owner[start:end], self.pooled(parts[start:end]))
            start = end
        return (np.tanh(h) @ self.weights + self.intercept).astype(np.float64)

    def step(self) -> float:
        """Width of a bin of log odds: all that the weights allow makes ``BINS`` bins."""
        return 2 * float(np.abs(self.weights).sum() + abs(self.intercept)) / BINS

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        z = self.scale * (self.raw(texts) - self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, s: ToxicitySettings) -> ToxicityModel:
    """Adam on the log loss with toxic and other rows of equal weight; gradients pass through the largest responses.

    Buckets that fewer than ``least_rows`` fitted rows touch stay zero: what a few rows hold by chance is not learned.
    """
    rng = np.random.default_rng(s.seed)
    k = len(s.widths) * s.filters
    model = ToxicityModel(
        s, rng.normal(0, 0.3, (s.buckets, s.size)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * s.size), (w, s.size, s.filters)).astype(np.float32) for w in s.widths],
        [np.zeros(s.filters, dtype=np.float32) for _ in s.widths],
        rng.normal(0, 0.3, k).astype(np.float32), 0.0)
    n = len(texts)
    seen = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(np.unique(t) for t in texts)]).astype(np.int64),
                       minlength=s.buckets)
    known = seen >= s.least_rows
    known[0] = False
    model.embedding[~known] = 0
    if n == 0 or labels.min() == labels.max():
        model.intercept, model.weights[:] = (3.0 if n and labels[0] else -3.0), 0
        return model
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    params = [model.embedding, *model.filters, *model.bias, model.weights, np.zeros(1, dtype=np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    epochs, step = max(s.epochs, min(150, 12_000 // n)), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 32):
            ids = order[at:at + 32]
            h, codes, places = model.pooled([texts[i] for i in ids], trace=True)
            a = np.tanh(h)
            p = 1 / (1 + np.exp(-np.clip(a @ params[-2] + params[-1][0], -30, 30)))
            g = (p - labels[ids]) * weight[ids] / len(ids)
            dh = np.outer(g, params[-2]) * (1 - a * a)
            grads = [np.zeros_like(q) for q in params[1:]]
            grads[-2][:], grads[-1][:] = a.T @ g, g.sum()
            touched, deltas = [], []
            for j, (width, place) in enumerate(zip(s.widths, places)):
                d = dh[:, j * s.filters:(j + 1) * s.filters]
                grads[len(s.widths) + j][:] = d.sum(axis=0)
                for i in range(width):
                    words = codes[place + i]
                    grads[j][i] = np.einsum("bf,bfe->ef", d, params[0][words].sum(axis=2))
                    delta = (d[:, :, None] * params[1 + j][i].T[None]).reshape(-1, s.size)
                    for c in range(3):
                        touched.append(words[:, :, c].ravel())
                        deltas.append(delta)
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            dense = np.zeros((len(rows), s.size), dtype=np.float32)
            np.add.at(dense, inverse, np.concatenate(deltas))
            dense[~known[rows]] = 0
            step += 1
            rate = s.rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for q, (m, v), gr, r in [(params[0], moments[0], dense, rows), *(
                    (q, mv, gr, slice(None)) for q, mv, gr in zip(params[1:], moments[1:], grads))]:
                m[r] = 0.9 * m[r] + 0.1 * gr
                v[r] = 0.999 * v[r] + 0.001 * gr * gr
                q[r] -= rate * m[r] / (np.sqrt(v[r]) + 1e-8)
    model.intercept = float(params[-1][0])
    return model


def best_cut(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the least balanced error.

    ``toxic`` and ``clean`` count the rows at each of the ascending, distinct values ``z``.
    """
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    false = np.concatenate([[clean.sum()], clean.sum() - np.cumsum(clean)]) / max(1, clean.sum())
    error = missed + false
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gaps = edges[1:] - edges[:-1]
    good = np.flatnonzero(error <= error.min() + 1e-12)
    k = good[gaps[good].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def calibrate(model: ToxicityModel, counts: list[tuple[str | None, int, int, int]]) -> ToxicityModel:
    """Puts the cut of all rows at 0.5, and takes a threshold for each language with both labels.

    ``counts`` are the rows of each (language, label, bin of the log odds).
    """
    bins = np.array([b for _, _, b, _ in counts], dtype=np.int64)
    label = np.array([y for _, y, _, _ in counts], dtype=np.int64)
    many = np.array([n for _, _, _, n in counts], dtype=np.int64)
    places: dict[str | None, list[int]] = {}
    for k, (lang, _, _, _) in enumerate(counts):
        places.setdefault(lang, []).append(k)

    def cut(rows) -> tuple[float, int, int]:
        found, inverse = np.unique(bins[rows], return_inverse=True)
        held = np.zeros((2, len(found)), dtype=np.int64)
        np.add.at(held, (label[rows], inverse), many[rows])
        return best_cut((found + 0.5) * model.step(), held[1], held[0]), int(held[1].sum()), int(held[0].sum())

    model.offset = cut(slice(None))[0]
    spread = (np.abs((bins + 0.5) * model.step() - model.offset) * many).sum() / many.sum()
    model.scale = float(np.clip(4 / max(1e-6, spread), 0.2, 5))
    for lang, rows in places.items():
        at, toxic, clean = cut(rows)
        z = np.clip(model.scale * (at - model.offset), -700, 700)
        model.thresholds[lang] = float(1 / (1 + np.exp(-z))) if toxic >= 5 and clean else 0.5
    return model


def train_toxicity(
    docs: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None, keep: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic",
) -> ToxicityModel:
    """Fits on at most ``max_train`` labelled rows, chosen by a digest of the id among those that ``keep`` allows.

    The ids are chosen first, so at most that many are broadcast; texts become word codes on the executors. Repeated
    ids count once, null ids or labels not at all. The offset and the thresholds then come from all labelled rows that
    ``keep`` allows, long texts too: texts are scored in place, and only ids and bins meet the labels.
    """
    s = settings or ToxicitySettings()
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    if keep:
        rows = rows.where(keep.format(id="_id"))
    mixed = F.xxhash64(F.lit(s.seed), "_id")
    half = s.max_train // 2
    chosen = rows.where("_label = 1").orderBy(mixed, "_id").limit(half).unionByName(
        rows.where("_label = 0").orderBy(mixed, "_id").limit(s.max_train - half))
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                        F.col(lang_col).cast("string").alias("_lang")).where("_id IS NOT NULL")
    if keep:
        known = known.where(keep.format(id="_id"))
    picked = known.join(F.broadcast(chosen), "_id").select("_id", "_text", "_lang", "_label")

    def make():
        coder = WordCoder(s.buckets)

        def work(batch: pa.RecordBatch) -> dict:
            codes = [coder(t or "") for t in batch.column(1).to_pylist()]
            return {"_id": batch.column(0), "_codes": [c.astype("<u2").tobytes() for c in codes],
                    "_label": batch.column(3).cast(pa.int32()), "_n": list(map(len, codes))}
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    found = per_batch(picked, make, f"_id {kind}, _codes binary, _label int, _n int").where(
        F.col("_n") <= s.max_words).limit(s.max_train).toPandas()
    found = found.drop_duplicates("_id").sort_values("_id")
    texts = [np.frombuffer(c, dtype="<u2").astype(np.int32).reshape(-1, 3) for c in found["_codes"]]
    model = fit(texts, found["_label"].to_numpy(dtype=np.float32), s)
    return calibrate(model, count_bins(known, rows, model, kind)) if model.weights.any() else model


def count_bins(docs: DataFrame, rows: DataFrame, model: ToxicityModel, kind: str) -> list[tuple]:
    """(language, label, bin, rows) over all of ``docs`` (_id, _text, _lang) that ``rows`` (_id, _label) label.

    No text is shuffled. A repeated id counts once, with its smallest language and bin.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        net = held.value
        coder = WordCoder(net.settings.buckets)

        def work(batch: pa.RecordBatch) -> dict:
            z = net.raw([coder(t or "") for t in batch.column(1).to_pylist()])
            return {"_id": batch.column(0), "_lang": batch.column(2),
                    "_bin": np.floor(z / net.step()).astype(np.int32)}
        return work

    binned = per_batch(docs, make, f"_id {kind}, _lang string, _bin int").groupBy("_id").agg(
        F.min(F.struct("_lang", "_bin")).alias("_at"))
    counts = binned.join(rows, "_id").groupBy("_at._lang", "_label", "_at._bin").agg(F.count(F.lit(1)).alias("_n"))
    return [tuple(r) for r in counts.select("_lang", "_label", "_bin", "_n").collect()]


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(id, score, flagged): the whole text's score, and whether it reaches its language's threshold.

    The language picks a threshold, 0.5 for one without labels, and never enters the score. A null text is empty and
    has a score, too; every row gives a row, repeated ids and null ones too; equal texts have equal scores; long texts
    are taken whole. An empty table gives an empty result; extra columns are not read, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # parameters: fixed size

    def make():
        judge = scorer(held.value)

        def work(batch: pa.RecordBatch) -> dict:
            score, flagged = judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            return {id_col: batch.column(0), "score": score, "flagged": flagged}
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(id_col, text_col, F.col(lang_col).cast("string")), make,
                     f"`{id_col}` {kind}, score double, flagged boolean")


def scorer(net: ToxicityModel):
    """From texts and languages to scores and whether they reach the language's threshold."""
    coder = WordCoder(net.settings.buckets)

    def judge(texts: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        score = net.score([coder(t or "") for t in texts])
        return score, score >= np.array([net.thresholds.get(x, 0.5) for x in langs], dtype=float)
    return judge


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, unchanged, that stay under the threshold of their language. A null text is empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        judge = scorer(held.value)
        return lambda batch: ~judge(batch.column(0).to_pylist(), batch.column(1).to_pylist())[1]

    return keep_rows(docs, [text_col, lang_col], make)
