"""Counts over whole texts, from which rules and classifiers take their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodewatch.llm.textkernels import Chunk, chunks, covered, mix

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words in a window that counts as repeated.
WINDOW = 5
#: Words of a stretch in which distinct words are counted, so that the share of them doesn't fall with a text's length.
STRETCH = 1000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_distinct", "n_same_next", "n_upper", "n_exclaim", "n_digit", "n_punct")
VARIETY = ("n_same_next", "n_stretch_distinct")


def _byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _byte_table(SYMBOLS)
_UPPER = _byte_table(bytes(range(65, 91)))
_EXCLAIM = _byte_table(b"!")
_DIGIT = _byte_table(b"0123456789")
_PUNCT = _byte_table(b".,;:?")


def _per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each (document, key) occurs, at each of its places, and whether the place is the first."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, bool)
    both = mix(key + mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, counts = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(both), bool)
    is_first[first] = True
    return counts[inverse], is_first


def _same_next(chunk: Chunk) -> np.ndarray:
    same = (chunk.hash[1:] == chunk.hash[:-1]) & (chunk.doc[1:] == chunk.doc[:-1])
    return _per_doc(chunk.doc[1:][same], chunk.n_docs)


def counts_of(chunk: Chunk, more: bool, variety: bool = False) -> dict[str, np.ndarray]:
    n, data = chunk.n_docs, chunk.data
    starts_char = (data & 0xC0) != 0x80
    out = {"n_words": chunk.n_words, "word_chars": chunk.sums(starts_char & ~chunk.space), "n_symbols": chunk.sums(_SYMBOL[data])}
    begin, end, line_doc = chunk.lines()
    first = np.searchsorted(chunk.start, begin)
    filled = (first < len(chunk.start)) & (np.append(chunk.start, len(data) + 1)[first] < end)
    begin, end, line_doc = begin[filled], end[filled], line_doc[filled]
    _, is_first = _repeats(line_doc, chunk.span_hash(begin, end))
    out["n_dup_lines"] = _per_doc(line_doc[~is_first], n)
    key, at = chunk.grams(WINDOW)
    times, _ = _repeats(chunk.doc[at] if len(at) else at, key)
    out["n_repeat_words"] = _per_doc(chunk.doc[covered(len(chunk.hash), at[times > 1], WINDOW)], n)
    if more:
        out["n_chars"] = chunk.sums(starts_char)
        out["n_lines"] = _per_doc(line_doc, n)
        _, is_first = _repeats(chunk.doc, chunk.hash)
        out["n_distinct"] = _per_doc(chunk.doc[is_first], n)
        out["n_same_next"] = _same_next(chunk)
        for name, of in (("n_upper", _UPPER), ("n_exclaim", _EXCLAIM), ("n_digit", _DIGIT), ("n_punct", _PUNCT)):
            out[name] = chunk.sums(of[data])
    if variety:
        out["n_same_next"] = _same_next(chunk)
        stretch = (np.arange(len(chunk.hash)) - chunk.first[chunk.doc]) // STRETCH if len(chunk.hash) else np.empty(0, np.int64)
        _, is_first = _repeats(chunk.doc, chunk.hash ^ mix(stretch.astype(np.uint64)))
        out["n_stretch_distinct"] = _per_doc(chunk.doc[is_first], n)
    return out


def text_counts(texts: DataFrame, more: bool = False, variety: bool = False) -> DataFrame:
    """``id`` and further columns as they are, ``text`` replaced by its counts. One narrow pass."""
    others = [f for f in texts.schema.fields if f.name != "text"]
    names = [*BASE, *(MORE if more else ()), *(VARIETY if variety else ())]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in others] + [f"{n} long" for n in names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, chunk in chunks(batch.column("text")):
                found = counts_of(chunk, more, variety)
                columns = [batch.column(f.name).slice(i, j - i) for f in others] + [pa.array(found[n], pa.int64()) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in others] + names)

    return texts.mapInArrow(each, schema)
