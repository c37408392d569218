"""Removal of long passages that repeat across documents, with suffix arrays over shards of the text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sqlcorpus.llm.blocks import in_blocks, measure_blocks, mix, shard_of, split_at
from sqlcorpus.llm.sais import permuted_prefixes, ranges, suffix_array

#: Bytes whose digest anchors a window; bytes of text that are digested, and sorted, at once, so that arrays fit a cache.
ANCHOR, STRIDE, SORTED = 20, 1 << 16, 1 << 18
#: A digest is hot when what surrounds it, at two widths a place, could fill more than this share of a block.
HOT_SHARE = 1.0
#: Places of a digest in one block from which on the block says how many there are.
MANY = 8
#: Values of the bits by which a shard's texts are divided into portions.
MARKS = 1 << 14
LAST = np.iinfo(np.int64).max


def digests(text: np.ndarray) -> np.ndarray:
    """Digests of all strings of ``ANCHOR`` bytes along the last axis."""
    h, step = text.astype(np.uint64) + np.uint64(1), 1
    levels = {1: h}
    while step * 2 <= ANCHOR:
        h = h[..., :-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[..., step:]
        h ^= h >> np.uint64(31)
        step *= 2
        levels[step] = h
    digest, have = levels[step], step
    while have < ANCHOR:
        step = max(s for s in levels if s <= ANCHOR - have)
        n = text.shape[-1] - have - step + 1
        digest = digest[..., :n] * np.uint64(0xC2B2AE3D27D4EB4F) + levels[step][..., have:have + n]
        have += step
    return mix(digest)


def anchors(text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first, last): runs of windows of ``width`` bytes, by place, whose smallest digest is the same one.

    ``ends`` are the ends of the documents that make up ``text``; windows lie inside one. Equal windows have the same
    smallest digest at the same place, so they belong to runs of the same digest.
    """
    inside = np.ones(len(text), dtype=bool)
    across = (ends[:, None] - np.arange(1, width)).ravel()
    inside[across[across >= 0]] = False
    out = []
    for start in range(0, max(len(text) - width + 1, 0), STRIDE):
        part = text[start:start + STRIDE + width - 1]
        digest = digests(part)
        low = (digest & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(digest), dtype=np.uint64)
        span, step = width - ANCHOR + 1, 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[:len(low) - (span - step)], low[span - step:])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = inside[start:start + len(at)]
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= new[1:] | ~valid[1:]
        first = np.flatnonzero(new)
        out.append((digest[at[first]], first + start, np.flatnonzero(last) + start))
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    digest, first, last = (np.concatenate(x) for x in zip(*out))
    return mix(digest + np.uint64(1)), first, last  # the smallest of many digests are far from even


def window_digests(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Digests of the windows of ``width`` bytes that begin at ``at``."""
    factors = np.random.default_rng(5).integers(0, 1 << 64, width, dtype=np.uint64)
    out = np.zeros(len(at), dtype=np.uint64)
    for i, factor in enumerate(factors):
        out += (text[at + i].astype(np.uint64) + np.uint64(1)) * factor
    return mix(out)


def shard_key(digest: np.ndarray, n_shards: int) -> np.ndarray:
    """Leading bits pick the shard, trailing ones tell digests apart in it; a clash only asks about more text."""
    return (shard_of(digest, n_shards).astype(np.uint64) << np.uint64(32)) | (digest & np.uint64(0xFFFFFFFC))


def tags_by_shard(keys: np.ndarray, flags: np.ndarray, counts: np.ndarray, block: int) -> pa.Table:
    """One row a shard of its ascending keys, with two flags in the trailing bits, and the counts of those that have
    the second flag."""
    value = (keys & np.uint64(0xFFFFFFFC)).astype(np.uint32) | flags.astype(np.uint32)
    many = flags >= 2
    shard, start, end = split_at((keys >> np.uint64(32)).astype(np.int64))
    return pa.table({
        "_shard": pa.array(shard, pa.int32()), "_block": pa.array(np.full(len(shard), block), pa.int32()),
        "_tags": pa.array([value[s:e].tobytes() for s, e in zip(start, end)], pa.binary()),
        "_counts": pa.array([counts[s:e][many[s:e]].astype(np.uint32).tobytes() for s, e in zip(start, end)], pa.binary())})


def read_bits(keys: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is shared, and whether it is hot."""
    by_shard = dict(zip(answers.column("_shard").to_pylist(), answers.column("_bits").to_pylist()))
    shared, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for shard, start, end in zip(*split_at((keys >> np.uint64(32)).astype(np.int64))):
        bits = np.unpackbits(np.frombuffer(by_shard[int(shard)], dtype=np.uint8), count=2 * (end - start)).astype(bool)
        shared[start:end], hot[start:end] = np.split(bits, 2)
    return shared, hot


def in_two(inverse: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` keys has two owners."""
    low, high = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, owner)
    np.maximum.at(high, inverse, owner)
    return low < high


class Block:
    """The documents of one block in a fixed order, their anchored runs, and the digests it asks about."""

    def __init__(self, part: pa.Table, n_shards: int, width: int) -> None:
        part = part.sort_by([("_id", "ascending"), ("_text", "ascending")])
        self.part, self.ids, self.texts = part, part.column("_id"), [t or b"" for t in part.column("_text").to_pylist()]
        self.rank = self.ids.cast(pa.int64()).combine_chunks().fill_null(LAST).to_numpy()
        self.raw = b"".join(self.texts)
        self.ends = np.cumsum([len(t) for t in self.texts]) if self.texts else np.zeros(1, dtype=np.int64)
        self.text = np.frombuffer(self.raw, dtype=np.uint8)
        digest, self.first, self.last = anchors(self.text, self.ends, width)
        self.owner = self.rank[np.searchsorted(self.ends, self.first, side="right")]
        self.key = shard_key(digest, n_shards)
        self.keys, self.inverse, self.counts = np.unique(self.key, return_inverse=True, return_counts=True)
        self.flags = in_two(self.inverse, self.owner, len(self.keys)) | (self.counts >= MANY) * 2
        self.n_shards, self.width = n_shards, width

    def questions(self, block: int) -> pa.Table:
        return tags_by_shard(self.keys, self.flags, self.counts, block)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, run) of the windows of ``runs``, the distinct keys of their digests, and which key each has."""
        many = self.last[runs] - self.first[runs] + 1
        at, run = ranges(self.first[runs], many), runs.repeat(many)
        key = shard_key(window_digests(self.text, at, self.width), self.n_shards)
        return at, run, *np.unique(key, return_inverse=True)

    def window_questions(self, answers: pa.Table, block: int) -> pa.Table:
        """What the block asks about each distinct window whose anchor is hot."""
        shared, hot = read_bits(self.keys, answers)
        _, run, keys, inverse = self.windows(np.flatnonzero((shared & hot)[self.inverse]))
        return tags_by_shard(keys, in_two(inverse, self.owner[run], len(keys)) * 1, np.zeros(len(keys)), block)

    def stretches(self, answers: pa.Table, of_windows: pa.Table) -> tuple[np.ndarray, ...]:
        """(first, last, run, shard, mark) in the order of shards: shared runs, and of hot ones each shared window."""
        shared, hot = read_bits(self.keys, answers)
        cold = np.flatnonzero((shared & ~hot)[self.inverse])
        at, run, keys, inverse = self.windows(np.flatnonzero((shared & hot)[self.inverse]))
        good = read_bits(keys, of_windows)[0][inverse]
        key = np.concatenate([self.key[cold], keys[inverse[good]]])
        mark = ((key >> np.uint64(2)) & np.uint64(MARKS - 1)).astype(np.uint16)
        shard = (key >> np.uint64(32)).astype(np.int64)
        found = (np.concatenate([self.first[cold], at[good]]), np.concatenate([self.last[cold], at[good]]),
                 np.concatenate([cold, run[good]]), shard, mark)
        order = shard.argsort(kind="stable")
        return tuple(x[order] for x in found)

    def passages(self, first: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The distinct texts of the stretches in the order of their first ones, and which of them each stretch has."""
        number: dict[bytes, int] = {}
        which = [number.setdefault(self.raw[s:e], len(number)) for s, e in zip(first.tolist(), (last + self.width).tolist())]
        return list(number), np.array(which, dtype=np.int64)


def answer(part: pa.Table, most: float) -> pa.Table:
    """Which tags of each block occur in two blocks, or in two documents of one, and which of those are hot, as they
    occur at over ``most`` places."""
    tags = [np.frombuffer(x, dtype=np.uint32) for x in part.column("_tags").to_pylist()]
    every = np.concatenate(tags)
    _, inverse, counts = np.unique(every >> np.uint32(2), return_inverse=True, return_counts=True)
    several = counts > 1
    several[inverse[(every & np.uint32(1)).astype(bool)]] = True
    places = np.ones(len(every))
    places[(every & np.uint32(2)).astype(bool)] = np.frombuffer(b"".join(part.column("_counts").to_pylist()), dtype=np.uint32)
    hot = several & (np.bincount(inverse, places, len(counts)) > most)
    cuts = np.cumsum([len(x) for x in tags])[:-1]
    bits = list(zip(np.split(several[inverse], cuts), np.split(hot[inverse], cuts)))
    return pa.table({"_block": part.column("_block"), "_shard": part.column("_shard"),
                     "_bits": pa.array([np.packbits(np.concatenate(x)).tobytes() for x in bits], pa.binary()),
                     "_hot": pa.array([bool(h.any()) for _, h in bits], pa.bool_())})


def first_owners(texts: list[bytes], owners: np.ndarray, width: int) -> np.ndarray:
    """For each window of each text the smallest owner of any text that holds it: groups of the suffix array."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1)
    t = np.empty(ends[-1] + 1, dtype=np.int32)
    t[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    t[:-1] += 2
    t[ends - 1], t[-1] = 1, 0
    sa = suffix_array(t, 258)
    prefixes = permuted_prefixes(t, sa, 1)
    # Both ends of a suffix array's run of long common prefixes hold the window, so the run is the window's group. Only
    # suffixes that begin with a window have long ones.
    windows = lengths - width + 1
    text_of = np.full(len(t), -1, dtype=np.int32)
    at = ranges(ends - lengths - 1, windows)
    text_of[at] = np.arange(len(texts), dtype=np.int32).repeat(windows)
    held = sa[text_of[sa] >= 0]
    group = np.flatnonzero(prefixes[held] < width)
    lowest = np.minimum.reduceat(owners[text_of[held]], group)
    result = np.empty(len(t), dtype=np.int64)
    result[held] = np.repeat(lowest, np.diff(np.append(group, len(held))))
    return result[at]


def judge(part: pa.Table, width: int) -> pa.Table:
    """The smallest owner of every window that the blocks sent to a shard, in the order in which they sent them.

    Texts with the same bits of their digest are sorted together, so a large shard is sorted in portions.
    """
    part = part.sort_by("_block")
    number: dict[bytes, int] = {}
    sent = []
    for blob, lengths in zip(*(part.column(c).to_pylist() for c in ("_texts", "_lengths"))):
        ends = np.cumsum(np.frombuffer(lengths, dtype=np.uint16), dtype=np.int64).tolist()
        sent.append([number.setdefault(blob[s:e], len(number)) for s, e in zip([0, *ends[:-1]], ends)])
    texts, every = list(number), np.concatenate([np.array(x, dtype=np.int64) for x in sent])
    owners, marks = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=kind)
                     for c, kind in (("_owners", np.int64), ("_marks", np.uint16)))
    lowest, mark = np.full(len(texts), LAST), np.empty(len(texts), dtype=np.uint16)
    np.minimum.at(lowest, every, owners)
    mark[every] = marks
    windows = np.array([len(t) - width + 1 for t in texts])
    starts = np.cumsum(windows) - windows
    found = np.empty(int(windows.sum()), dtype=np.int64)
    portions = -(-sum(map(len, texts)) // SORTED)
    for i in range(portions):
        chosen = np.flatnonzero(mark % portions == i)
        if len(chosen):
            found[ranges(starts[chosen], windows[chosen])] = first_owners(
                [texts[k] for k in chosen.tolist()], lowest[chosen], width)
    return pa.table({"_block": part.column("_block"), "_shard": part.column("_shard"), "_firsts": pa.array(
        [found[ranges(starts[own], windows[own])].tobytes() for own in map(np.array, sent)], pa.binary())})


def whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Marks only the characters all of whose bytes are marked."""
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.append(starts, len(text)))) if len(text) else gone


def remove_repeats(
    docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", characters: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of every document, as UTF-8 bytes.

    A byte goes if a string of ``width`` bytes covers it that also starts in a document with a smaller id, judged on
    the texts as they came; matches lie inside documents. ``spans`` are the maximal removed runs as (start, end).

    1. Blocks of documents send shards the digests that anchor their windows; shards answer which occur in two
       documents. All other text has no match and goes no further.
    2. A hot digest occurs so often that its contexts could outgrow a shard. Blocks ask in the same way about each
       distinct window around it, so that windows of one document only, at the ends of a passage, go no further; the
       others go one by one, each to the shard of its own digest.
    3. Blocks send each distinct stretch of the rest, once, to the shard of its anchor, with its smallest id. The
       shard sorts all suffixes of its stretches by prefix doubling; permuted common prefixes of ``width`` or more
       join windows, whose smallest id goes back.
    4. Blocks drop what a smaller id holds.

    Equal windows have equal anchors, so they meet in one shard, and are hot together. However many documents share a
    passage, and whatever surrounds it, a shard gets a window once a block, and the windows of a hot digest are spread
    over all shards. Null texts are empty; a null id counts as larger than all others; rows with the same id do not
    touch each other's bytes. With ``characters`` a character stays if one of its bytes does, so that ``kept`` is
    valid UTF-8. The columns ``carry`` come along as the struct ``rest``, so their names clash with none. Of equal
    passages the one with the smallest id stays; texts shorter than ``width`` stay whole, long ones are taken whole. An
    empty table gives an empty result; other columns are not read.
    """
    if not ANCHOR < width <= 1000:
        raise ValueError(f"width must be over {ANCHOR} and at most 1000")
    n, size = measure_blocks(docs, text_col)
    most = HOT_SHARE * size / (2 * width)
    texts = in_blocks(docs, n, id_col, text_col, carry)

    def ask(part: pa.Table) -> pa.Table:
        return Block(part, n, width).questions(part.column("_block")[0].as_py())

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not any(right.column("_hot").to_pylist()):
            return tags_by_shard(*(np.zeros(0, dtype=kind) for kind in (np.uint64, int, int)), 0)
        return Block(left, n, width).window_questions(right, left.column("_block")[0].as_py())

    def stretches(block: Block, right: pa.Table):
        rounds = right.column("_round")
        return block.stretches(right.filter(pc.equal(rounds, 1)), right.filter(pc.equal(rounds, 2)))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"_shard": [], "_block": [], "_texts": [], "_lengths": [], "_owners": [],
                                "_marks": []}
        if left.num_rows and right.num_rows:
            block = Block(left, n, width)
            first, last, run, shards, marks = stretches(block, right)
            texts, which = block.passages(first, last)
            one = np.unique(which, return_index=True)[1]
            lengths = np.array([len(t) for t in texts], dtype=np.uint16)
            owners = np.full(len(texts), LAST)
            np.minimum.at(owners, which, block.owner[run])
            # Equal texts have equal digests, so they are in one shard, and texts are in the order of their shards.
            for shard, start, end in zip(*split_at(shards[one])):
                rows["_shard"].append(int(shard))
                rows["_block"].append(left.column("_block")[0].as_py())
                rows["_texts"].append(b"".join(texts[start:end]))
                rows["_lengths"].append(lengths[start:end].tobytes())
                rows["_owners"].append(owners[start:end].tobytes())
                rows["_marks"].append(marks[one[start:end]].tobytes())
        return pa.table(rows, schema=pa.schema([
            ("_shard", pa.int32()), ("_block", pa.int32()), ("_texts", pa.binary()), ("_lengths", pa.binary()),
            ("_owners", pa.binary()), ("_marks", pa.binary())]))

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        asked_about = right.filter(pc.is_valid(right.column("_bits")))
        firsts = {s: f for s, f in zip(right.column("_shard").to_pylist(), right.column("_firsts").to_pylist())
                  if f is not None}
        block = Block(left, n, width)
        repeated = np.zeros(len(block.text), dtype=bool)
        if asked_about.num_rows:
            first, last, run, shards, _ = stretches(block, asked_about)
            texts, which = block.passages(first, last)
            one = np.unique(which, return_index=True)[1]
            windows = np.array([len(t) - width + 1 for t in texts], dtype=np.int64)
            starts = np.cumsum(windows) - windows
            low = np.concatenate([np.zeros(0, dtype=np.int64), *(
                np.frombuffer(firsts[int(shard)], dtype=np.int64) for shard in split_at(shards[one])[0])])
            hit = low[ranges(starts[which], windows[which])] < block.owner[run].repeat(windows[which])
            repeated[ranges(first, windows[which])[hit]] = True
        # A window covers the bytes up to its width, and windows lie inside documents.
        so_far = np.cumsum(repeated, dtype=np.int32)
        gone = so_far > 0
        gone[width:] = so_far[width:] > so_far[:-width]
        starts = np.append(0, block.ends[:-1])
        out: dict[str, list] = {"n_removed": [], "spans": [], "kept": []}
        for text, s, e in zip(block.texts, starts, block.ends):
            mask = whole_characters(block.text[s:e], gone[s:e]) if characters else gone[s:e]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            out["n_removed"].append(int(mask.sum()))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])])
            out["kept"].append(np.frombuffer(text, dtype=np.uint8)[~mask].tobytes() if len(turns) else text)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rest = {"rest": block.part.column("_rest")} if carry else {}
        return pa.table({
            id_col: block.ids, "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()),
            "n_removed": pa.array(out["n_removed"], pa.int64()), "spans": pa.array(out["spans"], spans),
            "kept": pa.array(out["kept"], pa.binary()), **rest})

    asked = texts.groupBy("_block").applyInArrow(ask, "_shard int, _block int, _tags binary, _counts binary")
    told = "_block int, _shard int, _bits binary, _hot boolean"
    answered = asked.groupBy("_shard").applyInArrow(lambda part: answer(part, most), told)
    asked_again = texts.groupBy("_block").cogroup(answered.groupBy("_block")).applyInArrow(
        ask_windows, "_shard int, _block int, _tags binary, _counts binary")
    answered_again = asked_again.groupBy("_shard").applyInArrow(lambda part: answer(part, float("inf")), told)
    answers = answered.withColumn("_round", F.lit(1)).unionByName(answered_again.withColumn("_round", F.lit(2)))
    sent = texts.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        send, "_shard int, _block int, _texts binary, _lengths binary, _owners binary, _marks binary")
    judged = sent.groupBy("_shard").applyInArrow(
        lambda part: judge(part, width), "_block int, _shard int, _firsts binary")
    back = answers.withColumn("_firsts", F.lit(None).cast("binary")).unionByName(
        judged.withColumn("_bits", F.lit(None).cast("binary")).withColumn("_hot", F.lit(None).cast("boolean")).withColumn(
            "_round", F.lit(3)))
    schema = StructType().add(id_col, docs.schema[id_col].dataType)
    for column in ("n_bytes long", "n_removed long", "spans array<struct<start:long,end:long>>", "kept binary"):
        schema.add(StructType.fromDDL(column).fields[0])
    if carry:
        schema.add("rest", texts.schema["_rest"].dataType)
    return texts.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(drop, schema)
