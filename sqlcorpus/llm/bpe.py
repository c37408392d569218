"""Byte-level BPE by pieces that no context can change, and a codec that reuses content-defined chunks."""

from __future__ import annotations

import array
import json
import re

import numpy as np

#: The characters of Unicode's White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with the white space just before it, or white space that precedes no such run.
PIECES = re.compile(f"[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
INNER = re.compile(f"(?<=[^{WHITE}])[{WHITE}](?=[^{WHITE}])")
PUNCTUATION = frozenset(",.!?;:")
#: Pieces that a task remembers before it starts anew, and chunks before it drops the oldest one.
MAX_PIECES, MAX_CHUNKS = 400_000, 60_000


class PieceEncoder(dict):
    """Token ids (little-endian unsigned 32-bit bytes) by piece, encoded once while remembered.

    The vocabulary's pattern never joins characters on both sides of a piece's borders, so ids of a text are those
    of its pieces in order. A piece that ends with one mark after an ASCII letter consists of two pre-tokens.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or (
                split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path} does not divide texts by the byte-level pattern, which pieces are cut for")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = ranks_encoder(self.tokenizer)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        if len(piece) > 2 and piece[-1] in PUNCTUATION and piece[-2].isascii() and piece[-2].isalpha():
            ids = self[piece[:-1]] + self[piece[-1]]
        else:
            ids = array.array("I", self.quick(piece)).tobytes()
        if len(piece) <= 256:
            self[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, PIECES.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; a text with a special token's string goes to the library."""
        if any(s in text for s in self.special):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.plain(text)


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: Latin-1's own, then code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
    return table


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id, special tokens as their text."""
    symbols = byte_of_symbol()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = [b""] * (max([*vocabulary.values(), *special]) + 1)
    for token, i in vocabulary.items():
        out[i] = special[i] if i in special else bytes(symbols[c] for c in token)
    for i, text in special.items():
        out[i] = text
    return out


def ranks_encoder(tokenizer):
    """Merges of the same vocabulary by rank, much cheaper for a single piece than a call of the library."""
    import tiktoken

    special = tokenizer.get_added_tokens_decoder()
    ranks = {b: i for i, b in enumerate(token_bytes(tokenizer)) if i not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def content_cuts(text: str, window: int = 16, bits: int = 8) -> list[int]:
    """Cuts after the characters where a hash of the last ``window`` ends in ``bits`` zeros: the same in any text."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if len(codes) <= window:
        return []
    h, step, factor = codes * np.uint32(2654435761), 1, np.uint32(0x01000193)
    h = h ^ (h >> np.uint32(15))
    while step < window:
        h = h[:-step] * factor + h[step:]
        factor, step = np.uint32(int(factor) ** 2 & 0xFFFFFFFF), step * 2
    h ^= h >> np.uint32(16)
    return (np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits) == 0) + window).tolist()


class ChunkCodec:
    """Encodes content-defined chunks once, however many texts share them, and repairs the joins between them.

    A remembered chunk is (head, ids, tail): what precedes its first and follows its last border that no context can
    move, and the ids between. The tail of what came before is encoded anew together with the next head; both sides
    then agree exactly, as the border is one in the whole text too. A chunk without such a border lengthens the join.
    """

    def __init__(self, path: str) -> None:
        self.pieces = PieceEncoder(path)
        self.table = token_bytes(self.pieces.tokenizer)
        self.chunks: dict[str, tuple[str, bytes, str] | None] = {}
        self.reused = self.seen = 0

    def chunk(self, text: str) -> tuple[str, bytes, str] | None:
        first = INNER.search(text)
        if first is None:
            return None
        a = first.start()
        pieces = PIECES.findall(text, a)
        k = len(pieces) - 1
        while k > 0 and not (INNER.match(pieces[k - 1][-1] + pieces[k], 1)):
            k -= 1
        return text[:a], b"".join(map(self.pieces.__getitem__, pieces[:k])), "".join(pieces[k:])

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.pieces.special):
            return self.pieces.encode(text)
        out, carry, start, known = [], "", 0, self.chunks
        for cut in [*content_cuts(text), len(text)]:
            part, start = text[start:cut], cut
            self.seen += 1
            if part in known:
                found = known[part]
                self.reused += 1
            else:
                found = self.chunk(part)
                if len(known) >= MAX_CHUNKS:
                    del known[next(iter(known))]
                if len(part) <= 4096:
                    known[part] = found
            if found is None:
                carry += part
                continue
            head, ids, tail = found
            out += (self.pieces.plain(carry + head), ids)
            carry = tail
        out.append(self.pieces.plain(carry))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")
