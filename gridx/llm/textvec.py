"""Vectorised byte and word primitives shared by the document operators.

Everything here works on one Arrow batch at a time, in numpy, without a Python object per word: a batch of
texts is one byte buffer plus offsets, words are (start, end) pairs, and word and window hashes come from a
prefix polynomial over the buffer. Memory is a constant times the chunk size; a chunk holds at least one text,
so one text of any length is handled whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at a time; the power tables have one entry more, a power of two.
CHUNK_BYTES = (1 << 20) - 1
CHUNK_DOCS = 1 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n (at least), modulo 2**64; grown on demand and kept per worker."""
    if len(_pow[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, b in ((0, BASE), (1, BASE_INV)):
            steps = np.full(size, U(b))
            steps[0] = U(1)
            _pow[k] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def tidy() -> None:
    """Give freed memory back to the system at the end of a task: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift) applied to every element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_fold = np.arange(256)
_fold[65:91] += 32
_BYTE_LOWER = _BYTE[_fold]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, most_bytes: int = CHUNK_BYTES, most_docs: int = CHUNK_DOCS) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most most_docs rows and, unless a single row is longer, most_bytes bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most_bytes, side="right")) - 1
        j = min(max(j, i + 1), i + most_docs, n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """P with P[j] - P[i] = sum of value(byte) * BASE**position over [i, j), modulo 2**64."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
    """Position-free hash of each byte range, given as index arrays or matching slices of the prefix array."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[at])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes outside 0x20 and 0x09 to 0x0D; never across documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def shingles(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word shingle of width words, A-Z folded to a-z.

    A document of fewer words gives one shingle, its whole word sequence, which no longer sequence equals; a
    document without words gives none. Rows come in document order; repeats are kept.
    """
    s, e, doc = words(data, off)
    n_docs = len(off) - 1
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, U)
    prefix = prefix_hash(data, lower=True)
    _, inverse = _powers(len(data) + 1)
    w = mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U) * U(0xA24BAED4963EE407))
    per = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(per)))[:-1]
    length = np.minimum(per, width)
    h = w.copy()
    rank = np.arange(len(w)) - first[doc]
    for j in range(1, width):
        nxt = np.zeros(len(w), U)
        nxt[: max(0, len(w) - j)] = w[j:]
        within = rank + j < per[doc]
        h = np.where(within, mix(h * U(0x9FB21C651E98DF25) + nxt + U(j)), h)
    keep = rank <= (per - length)[doc]
    h = h + length[doc].astype(U) * U(0xC2B2AE3D27D4EB4F)
    return doc[keep], mix(h[keep])
