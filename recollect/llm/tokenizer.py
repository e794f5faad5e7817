"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 8).

Monoid tree reduction: a long text is encoded in halves, recursively down to leaves, and two neighbours are joined by encoding a
window around their seam again. The window grows until tokens outside it provably stay as they are, which is so where

* it ends at a certain boundary: a change of character class at which every match of the splitting pattern must end whatever lies
  around it (letter to anything but a letter, digit to anything but a digit, other sign to white space or digit), or
* inside a run of one class, the tokens on both sides of the window's end encode as just themselves when put together; a sequence
  of byte-pair tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs.

Decoding concatenates the tokens' bytes up the tree. No text is encoded by a single pass over a long unbroken run, whose cost is more than linear.

Defined results: a null and an empty text have the empty list; strings of special tokens in a text are ordinary text; equal texts
have equal ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
LEAF_CHARS = 1024
# Fixed value: the public splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, DIGIT, SPACE, OTHER, UNKNOWN = "LNSO?"


@lru_cache(maxsize=4096)
def char_class(ch: str) -> str:
    """Class of a character for the splitting pattern; ``UNKNOWN`` where Unicode versions may disagree."""
    category = unicodedata.category(ch)
    if category == "Cn" or "\x1c" <= ch <= "\x1f":
        return UNKNOWN
    if ch.isspace():
        return SPACE
    return LETTER if category[0] == "L" else DIGIT if category[0] == "N" else OTHER


def certain_boundary(a: str, b: str) -> bool:
    """Whether a match must end between the characters ``a`` and ``b``, whatever surrounds them."""
    x, y = char_class(a), char_class(b)
    return x != y and UNKNOWN not in (x, y) and x != SPACE and (x, y) != (OTHER, LETTER)


class TreeEncoder:
    """Encodes and decodes with byte-pair ranks, long texts by tree reduction."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_CHARS):
        import tiktoken

        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._fits: dict[tuple[int, int], bool] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self._node(text, 0, len(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8")

    def _node(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.bpe.encode_ordinary(text[start:end])
        mid = (start + end) // 2
        return self._join(text, start, mid, end, self._node(text, start, mid), self._node(text, mid, end))

    def _join(self, text: str, start: int, mid: int, end: int, left: list[int], right: list[int]) -> list[int]:
        reach = 32
        while True:
            low = next((p for p in range(mid, max(start, mid - reach), -1) if p > start and certain_boundary(text[p - 1], text[p])), None)
            high = next((p for p in range(mid, min(end, mid + reach)) if certain_boundary(text[p - 1], text[p])), None)
            low, high = start if low is None and mid - reach <= start else low, end if high is None and mid + reach >= end else high
            if low is not None and high is not None:
                break
            if reach >= 512 and (joined := self._join_in_run(text, mid, reach, start, end, left, right)) is not None:
                return joined
            reach *= 2
        keep = self._without_tail(left, len(text[low:mid].encode()))
        skip = self._head_length(right, len(text[mid:high].encode()))
        return left[:keep] + (self.bpe.encode_ordinary(text[low:high]) if high > low else []) + right[skip:]

    def _join_in_run(self, text: str, mid: int, reach: int, start: int, end: int, left: list[int], right: list[int]) -> list[int] | None:
        """Join inside a run of one class that fills the window, or None where it doesn't or tokens don't settle within it."""
        if mid - reach < start or mid + reach > end:
            return None
        kind = char_class(text[mid])
        if kind == UNKNOWN or any(char_class(c) != kind for c in text[mid - reach : mid + reach]):
            return None
        room_left, room_right = len(text[mid - reach : mid].encode()) - 8, len(text[mid : mid + reach].encode()) - 8
        k = 8
        while k < len(left) and k < len(right):
            tail, head = left[-k:], right[:k]
            inside = sum(len(self.bytes_of[t]) for t in left[-k - 1 :]) <= room_left and sum(len(self.bytes_of[t]) for t in right[: k + 1]) <= room_right
            if not inside:
                return None
            middle = self._piece(b"".join(self.bytes_of[t] for t in tail + head))
            if self._neighbours(left[-k - 1], middle[0]) and self._neighbours(middle[-1], right[k]):
                return left[:-k] + middle + right[k:]
            k *= 2
        return None

    def _piece(self, data: bytes) -> list[int]:
        return self.bpe._encode_single_piece(data)

    def _neighbours(self, a: int, b: int) -> bool:
        if (a, b) not in self._fits:
            if len(self._fits) > 100_000:
                self._fits.clear()
            self._fits[a, b] = self._piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self._fits[a, b]

    def _without_tail(self, ids: list[int], n_bytes: int) -> int:
        k = len(ids)
        while n_bytes > 0:
            k -= 1
            n_bytes -= len(self.bytes_of[ids[k]])
        assert n_bytes == 0, "a certain boundary must end a token"
        return k

    def _head_length(self, ids: list[int], n_bytes: int) -> int:
        k = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[k]])
            k += 1
        assert n_bytes == 0, "a certain boundary must end a token"
        return k


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of a token's bytes and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_ENCODERS: dict[int, TreeEncoder] = {}


def vocabulary(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> bytes:
    """The vocabulary file's bytes; it has a fixed size, under 1 MB."""
    with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
        return f.read()


def encoder(data: bytes) -> TreeEncoder:
    """The encoder of a vocabulary, made once per Python worker."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(read_ranks(data))
    return _ENCODERS[key]


def encode_column(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep`` and ``ids`` of every row. Batches stream through Arrow; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    out = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            ids = pa.array([enc.encode(t) for t in batch.column(len(keep)).to_pylist()], type=out)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=[*keep, "ids"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def token_ids(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, ids`` of every document."""
    return encode_column(docs, ["doc_id"], tokenizer=tokenizer, folder=folder)


def token_counts(docs: DataFrame, keep: list[str], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep`` and ``n_tokens`` of every document."""
    return encode_column(docs, keep, tokenizer=tokenizer, folder=folder).select(*keep, F.size("ids").alias("n_tokens"))


def decoded(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; the empty list gives the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(i) for i in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
