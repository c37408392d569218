"""Suffix arrays by prefix doubling and permuted common prefixes, in whole-array steps."""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def packed(t: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The ``count`` values of ``bits`` bits that begin at each place, the first ones leading; zeros follow the end."""
    out = t.astype(np.int64)
    have = 1
    while have < count:
        step = min(have, count - have)
        more = out[have:] >> (bits * (have - step))
        out <<= bits * step
        out[:len(more)] |= more
        have += step
    return out


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of ``t`` in order; its last element is 0 and no other is. Values are below ``size``, places 2 ** 31.

    Suffixes are sorted by as many characters as a word holds. A group's rank is the place of its first suffix. Groups
    of several are sorted by the rank of what follows the characters compared so far, which doubles them, till all are
    alone.
    """
    n = len(t)
    bits = max(size - 1, 1).bit_length()
    depth = 63 // bits
    key = packed(t, bits, depth)
    order = key.argsort()
    places, suffixes, rank = np.arange(n), order, np.empty(n, dtype=np.int64)
    key = key[order]
    while True:
        new = np.ones(len(key) + 1, dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        first = np.flatnonzero(new[:-1])
        rank[suffixes] = places[first].repeat(np.diff(np.append(first, len(key))))
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(tied):
            return order.astype(np.int32)
        # Equal so far, so the end is not among what was compared, and the group's places are kept by its suffixes.
        places, suffixes = places[tied], suffixes[tied]
        key = (rank[suffixes] << 32) | rank[suffixes + depth]
        by = key.argsort()
        key, suffixes = key[by], suffixes[by]
        order[places] = suffixes
        depth *= 2


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """Common prefix of each suffix, in text order, with the one before it in sorted order; a value up to ``stop`` ends it.

    If both suffixes follow the same character, the value is one less than that of the suffix before; only the others
    are compared.
    """
    n = len(t)
    t, places = t.astype(np.int32), np.arange(n, dtype=np.int32)
    prior = np.empty(n, dtype=np.int32)
    prior[sa[1:]] = sa[:-1]
    prior[sa[0]] = n - 1
    reducible = np.zeros(n, dtype=bool)
    reducible[1:] = (t[:-1] == t[prior[1:] - 1]) & (prior[1:] > 0) & (t[:-1] > stop)
    starts = np.flatnonzero(~reducible)
    value = np.zeros(n, dtype=np.int32)
    active, offset = starts[starts != sa[0]], 0
    while len(active):
        x, y = t[active + offset], t[prior[active] + offset]
        active = active[(x == y) & (x > stop)]
        offset += 1
        value[active] = offset
    base = np.maximum.accumulate(np.where(reducible, np.int32(-1), places))
    return value[base] - (places - base)
