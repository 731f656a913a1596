"""Array kernels over whole texts: words, lines and n-grams of many documents at once.

A word is a run of bytes other than space and tab to carriage return; those
bytes are ASCII, so words of UTF-8 bytes are words of characters.  Each byte
gets a random 64-bit value, prefix sums of ``value * base**position`` give the
hash of any span in constant time, and all of it is numpy, without a loop over
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one call of a kernel takes, unless one document is longer.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64, for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(CHUNK_BYTES, 1 << int(n).bit_length()) + 1
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Chunk:
    """The words of consecutive documents: ``hash``, ``start``, ``end`` by word; ``first`` by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        up, down = _power_tables(n)
        self._down = down
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * up[:n], out=self.prefix[1:])
        space = _SPACE[data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:] = space
        after[:n] = space
        inner = offsets[(offsets > 0) & (offsets < n)]
        cut_before, cut_after = before[:n].copy(), after[1:].copy()
        cut_before[inner] = True
        cut_after[inner - 1] = True
        self.start = np.flatnonzero(~space & cut_before)
        self.end = np.flatnonzero(~space & cut_after) + 1
        self.space = space
        self.hash = self.span_hash(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.n_docs = len(offsets) - 1
        self.n_words = np.diff(self.first)
        self._doc: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        if self._doc is None:
            self._doc = np.repeat(np.arange(self.n_docs), self.n_words)
        return self._doc

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self._down[start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words that lie in one document, and the word at which each starts."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hash[j : j + n] * _GRAM[j]
        return mix(out[at]), at

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask marks."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[self.offsets])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line (texts split at line feeds)."""
        feeds = np.flatnonzero(self.data == 10)
        doc_of = np.searchsorted(self.offsets, feeds, side="right") - 1
        start = np.concatenate([self.offsets[:-1], feeds + 1])
        end = np.concatenate([self.offsets[1:], feeds])
        docs = np.concatenate([np.arange(self.n_docs), doc_of])
        order = np.lexsort((start, docs))
        stop = np.lexsort((end, np.concatenate([np.arange(self.n_docs), doc_of])))
        return start[order], end[stop], docs[order]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, count=n + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most so many bytes together; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def chunks(column: pa.Array, fold: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """``Chunk`` by ``Chunk``, with the rows of the column that it holds."""
    data, offsets = buffers(column)
    for i, j in pieces(offsets, most):
        yield i, j, Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold)


def covered(n_words: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Marks the words in runs of k words that begin at the given words."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n_words), -1)
    return np.cumsum(step[:n_words]) > 0
