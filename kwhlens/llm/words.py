"""Vectorised word and shingle hashing over Arrow string columns.

Texts are hashed straight from the Arrow buffers with NumPy, so no Python
object is made per word.  All helpers work on whole texts; long inputs are cut
into slices of about ``SLICE_BYTES`` at document boundaries (a longer document
is one slice), which bounds the scratch memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes hashed at once; scratch memory is about 30 times this.
SLICE_BYTES = 1 << 18

_U = np.uint64
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), so that high and low bits are usable alike."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For matching text by content: besides white space, ASCII punctuation separates words.
_PUNCT = _SPACE.copy()
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
        p[0] = 1
        have = _powers[name] = np.cumprod(p, dtype=np.uint64)
    return have


def tidy(run: Callable) -> Callable:
    """``run`` as a mapInArrow function that hands its freed memory back when the task ends.

    Spark keeps Python workers for later tasks; what they hold idle counts against the executor.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return tidied


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only few are Python objects at once."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents holding about ``limit`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, off: np.ndarray, punct: bool = False, spans: bool = False,
                lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of the words of documents, lower-cased (A-Z) unless told otherwise, and each document's first word.

    ``off`` holds the byte offsets of the documents (one more than documents).
    Returns (hash per word, word offset per document, word start bytes).
    """
    base = int(off[0])
    buf = raw[base : int(off[-1])]
    n = len(buf)
    docs = off - base
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros((0, 2), np.int64) if spans else None
    solid = ~(_PUNCT if punct else _SPACE)[buf]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = docs[:-1][docs[:-1] < n]
    begin[heads] = solid[heads]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    tails = docs[1:][docs[1:] > 0] - 1
    end[tails] = solid[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    low = _LOWER[buf] if lower else buf
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * _power(_MUL, n, "mul")[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INV, n, "inv")[starts]
    first = np.searchsorted(starts, docs)
    return mix(h), first, (np.stack([starts, ends], 1) if spans else None)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; entry i covers words i..i+k-1 (document borders not regarded)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for j in range(1, k):
        out = mix(out * _U(_MUL)) + words[j : j + m]
    return mix(out)


def short_hash(words: np.ndarray) -> np.uint64:
    """One hash for a sequence of fewer than k words; its length is part of it."""
    x = np.array([len(words) + 0x51], dtype=np.uint64)
    for w in words:
        x = mix(x * _U(_MUL)) + w
    return mix(x ^ _U(0xA5A5A5A5A5A5A5A5))[0]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every text of a string column.

    A text of fewer than ``k`` words has its whole word sequence as one
    shingle; a null text, or one without words, has none.
    """
    raw, off = text_buffers(column)
    for i, j in slices(off):
        words, first, _ = word_hashes(raw, off[i : j + 1])
        grams = shingle_hashes(words, k)
        for r in range(i, j):
            a, b = int(first[r - i]), int(first[r - i + 1])
            if b - a >= k:
                yield r, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield r, np.array([short_hash(words[a:b])], dtype=np.uint64)
            else:
                yield r, np.zeros(0, np.uint64)
