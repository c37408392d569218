"""Token ids, round trips and token counts of whole texts."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from sqlcorpus.llm.bpe import MAX_PIECES, ChunkCodec
from sqlcorpus.llm.common import per_batch


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ids as little-endian unsigned 32-bit bytes, equal to the library's, and their text again.

    Chunks that texts share are encoded once a task and joins repaired (``bpe.ChunkCodec``). A null text is empty;
    every row gives a row, repeated ids and null ones too; long texts are taken whole. An empty table gives an empty
    result; extra columns are not read, whatever their names.
    """
    def make():
        codec = ChunkCodec(path)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "ids": ids, "decoded": list(map(codec.decode, ids))}
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_texts`` with the digests taken where the ids are made: (id, n_tokens, ids_sha256, decoded_sha256).

    Odd rows and tables are treated as there.
    """
    def make():
        codec = ChunkCodec(path)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            return {
                id_col: batch.column(0), "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids]}
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(id_col, text_col), make,
                     f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: The pre-tokens of the lower-cased vocabulary, for ASCII text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point lower case maps one character to one, but for the two named.
PLAIN_LIMIT, NOT_PLAIN = "ƀ", frozenset("İŉ")


def check_pattern(tokenizer, path: str) -> None:
    """Refuse a vocabulary that divides or changes texts in another way than the counter takes for granted."""
    spec = json.loads(tokenizer.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    changes = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if steps[0].get("pattern") != {"Regex": PRE_TOKENS} or changes != ["NFC", "Replace", "Lowercase"]:
        raise ValueError(f"{path} does not divide texts by the pattern of the lower-cased vocabulary")


class TokenCounter(dict):
    """Tokens of a run of bytes without ASCII white space, remembered by run.

    ``whole`` lists the whole tokens that ``prove_whole`` has shown. A pre-token that is one counts 1 at once; only
    the rest is merged by the library. White space ends every pre-token, so a text has as many tokens as its runs
    together.
    """

    def __init__(self, path: str, whole: list[str] | None = None) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        check_pattern(t, path)
        self.pattern = regex.compile(PRE_TOKENS)
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.words = dict.fromkeys(prove_whole(path) if whole is None else whole, 1)
        self.whole = len(self.words)

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> int:
        n = self.merged(word)
        if len(self.words) < self.whole + MAX_PIECES:
            self.words[word] = n
        return n

    def __missing__(self, run: bytes) -> int:
        text, words = run.decode("utf-8"), self.words
        if any(s in text for s in self.special) or not is_plain(text):
            n = self.merged(text)
        else:
            n = sum(words.get(w) or self.word(w) for w in self.pattern.findall(text.lower()))
        if len(self) >= MAX_PIECES:
            self.clear()
        if len(run) <= 256:
            self[run] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


def is_plain(text: str) -> bool:
    """Whether normal form and lower case of the text are surely those that Python gives."""
    return text.isascii() or (
        max(text) < PLAIN_LIMIT and not NOT_PLAIN.intersection(text) and unicodedata.is_normalized("NFC", text)
        and not re.search(r"\s", text))


def prove_whole(path: str) -> list[str]:
    """Vocabulary strings that are a whole pre-token and encode alone as one token, each shown by encoding it."""
    import regex
    from tokenizers import Tokenizer

    tokenizer, pattern = Tokenizer.from_file(path), regex.compile(PRE_TOKENS)
    check_pattern(tokenizer, path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    from sqlcorpus.llm.bpe import byte_of_symbol

    symbols, texts = byte_of_symbol(), []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token.endswith("</w>") and token not in special and all(c in symbols for c in token[:-4]):
            try:
                text = bytes(symbols[c] for c in token[:-4]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if pattern.findall(text) == [text]:
                texts.append(text)
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, found) if len(e.ids) == 1]


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the library counts.

    A null text is empty, and has no tokens; every row gives a row, repeated ids and null ones too; a text of exactly
    ``limit`` tokens is not over it. An empty table gives an empty result; extra columns are not read, whatever their
    names.

    Whole tokens are proved once, by the driver, and broadcast: they are part of the vocabulary, so their size is fixed.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))

    def make():
        counter = TokenCounter(path, whole.value)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            counts = list(map(counter.count, texts))
            return {id_col: batch.column(0), "n_bytes": list(map(len, texts)), "n_tokens": counts,
                    "over_limit": [n > limit for n in counts]}
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(id_col, text_col), make,
                     f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
