"""Vectorised text kernels over Arrow string buffers.

All word-level operators of this subpackage work on bytes: a batch of texts is
one ``uint8`` array with document offsets, words are runs of bytes of a class,
and a word is known by a 64-bit hash.  Nothing here is row-at-a-time Python.
Two words with equal bytes have equal hashes on every executor; different words
meet with probability about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute, for all kernels)

#: Bytes of text handled at once by a kernel; a longer document is a piece of its own.
PIECE_BYTES = 2 << 20
#: Bytes whose hashes are summed at once.
BLOCK = 1 << 15

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def byte_class(pattern_bytes: Iterator[int] | range | list[int], invert: bool = False) -> np.ndarray:
    """A 256-entry membership table."""
    lut = np.zeros(256, bool)
    lut[list(pattern_bytes)] = True
    return ~lut if invert else lut


#: ASCII white space: 0x20 and 0x09 to 0x0D; all other bytes make words.
SPACE = byte_class([0x20, *range(0x09, 0x0E)])
NOT_SPACE = ~SPACE
#: Digits, a-z and all non-ASCII bytes (texts are lower-cased first).
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], invert=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def _symbols() -> np.ndarray:
    if 0 not in _TABLES:
        _TABLES[0] = mix(np.arange(1, 0x110001, dtype=U) * U(0xA24BAED4963EE407))
    return _TABLES[0]


def _powers(n: int, inverse: bool) -> np.ndarray:
    key = 2 if inverse else 1
    have = _TABLES.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, _BASE_INV if inverse else _BASE, U)
        steps[0] = 1
        have = _TABLES[key] = np.cumprod(steps, dtype=U)
    return have


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most ``limit`` bytes, one row at least."""
    data, offs = buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and how many words lie before each document (one entry more than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = member[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = w.copy(), w
    first[1:] &= ~w[:-1] | cut[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span (spans ordered and disjoint)."""
    out = np.empty(len(starts), U)
    table, lo = _symbols(), 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        size = int(ends[hi - 1]) - base
        up, down = _powers(size + 1, False), _powers(size + 1, True)
        total = np.zeros(size + 1, U)
        np.cumsum(table[data[base : base + size]] * up[:size], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(U)
        lo = hi
    return mix(out)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each word, from counts before documents."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of all k-word windows inside documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    own = owners(bounds)
    at = np.flatnonzero(own[: n] == own[k - 1 :])
    total = np.zeros(n, U)
    for j in range(k):
        total += hashes[j : j + n] * U((2 * j + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
    return at, mix(total[at])


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans as Arrow strings, without a Python object for each."""
    sizes = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    index = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs), pa.py_buffer(data[index]))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of strings."""
    data, offs = buffers(texts)
    lead = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, before[offs]


def char_ngrams(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all n-grams of code points inside each string."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    own = owners(offsets)
    at = np.flatnonzero(own[:count] == own[n - 1 :])
    symbols, total = _symbols(), np.zeros(count, U)
    for j in range(n):
        total += symbols[points[j : j + count]] * U((2 * j + 5) * 0xC2B2AE3D27D4EB4F % (1 << 64) | 1)
    return own[at], mix(total[at] + U(n))


def lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted key in sorted keys, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's values (empty documents: 0)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "bi" else values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def order_by_owner(owner: np.ndarray, key: np.ndarray, stable: bool = False) -> np.ndarray:
    """Order by owner, then key; a radix sort puts owners together last."""
    first = np.argsort(key, kind="stable" if stable else None)
    small = owner.astype(np.uint16) if not len(owner) or owner.max() < 1 << 16 else owner
    return first[np.argsort(small[first], kind="stable")]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, in the order given, with one space between those of a document: (bytes, starts, ends of documents there)."""
    sizes = ends - starts + 1
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    index = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)
    if len(starts):
        index[offs[1:] - 1] = 0
    out = data[index] if len(data) else np.zeros(0, np.uint8)
    if len(starts):
        out[offs[1:] - 1] = 32
    first = offs[bounds[:-1]]
    return out, first, np.maximum(offs[bounds[1:]] - 1, first)
