"""Encoding of texts with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is a row of bytes whose
neighbouring tokens are merged, the pair of lowest rank first and the leftmost
of equal rank. A segment tree over the byte positions stores the least (rank,
position) of the live pairs, so that one merge is two logarithmic point updates:
a piece of n bytes takes O(n log n) steps, whatever it holds.

Null and empty texts have the empty list of ids. Whole texts are encoded, of any
length; texts that are no valid UTF-16 (lone surrogates) are encoded with the
replacement character. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are unless the caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value of the vocabulary: how it splits a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers, and the longest of them in characters.
MEMO, MEMO_CHARS = 200_000, 48

_NONE = 1 << 62
_BITS = 32
_MASK = (1 << _BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, the rank of the merge that makes the token."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by a segment tree of the least pair ranks."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    rank_of = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << _BITS | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    following = list(range(1, n + 1))  # where the token after the one at i begins
    before = list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        node = size + at
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            least = value if value < other else other
            if tree[node] == least:
                return
            tree[node] = value = least

    while tree[1] != _NONE:
        at = tree[1] & _MASK
        gone = following[at]
        end = following[gone]
        following[at] = end
        if end < n:
            before[end] = at
            rank = rank_of(piece[at : following[end]])
            put(at, _NONE if rank is None else rank << _BITS | at)
        else:
            put(at, _NONE)
        if gone < n - 1:
            put(gone, _NONE)
        prior = before[at]
        if prior >= 0:
            rank = rank_of(piece[prior:end])
            put(prior, _NONE if rank is None else rank << _BITS | prior)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : following[at]]])
        at = following[at]
    return ids


class Encoder:
    """Texts -> ids; remembers the ids of pieces, which changes no result."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split, self.memo = ranks, regex.compile(pattern).findall, {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """One encoder for each broadcast vocabulary and worker."""
    if vocabulary.value[0] not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.value[0]] = Encoder(vocabulary.value[1])
    return _encoders[vocabulary.value[0]]


def _broadcast(df: DataFrame, tokenizers: str, name: str):
    """The vocabulary, of a size fixed by its file (under 2 MB), on all executors."""
    ranks = read_ranks(f"{tokenizers}/{name}")
    return df.sparkSession.sparkContext.broadcast((hash((name, len(ranks))), ranks))


def encode(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``key`` and ids (array of int) of every row of ``df``."""
    vocabulary = _broadcast(df, tokenizers, name)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            lists = [encoder(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, text: str, tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with n_tokens (bigint)."""
    vocabulary = _broadcast(df, tokenizers, name)
    kept = [c for c in df.columns if c != text]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            sizes = pa.array([len(encoder(t)) for t in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], sizes], [*kept, "n_tokens"])

    return rows.mapInArrow(run, f"{schema}, n_tokens bigint")
