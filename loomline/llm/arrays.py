"""Vectorised text primitives shared by the Arrow-based operators.

An Arrow string column is one byte buffer plus offsets, so words, lines and
their hashes are found with a few NumPy passes over all texts of a block and no
per-row Python.  A null text has equal offsets and so counts as empty.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

#: Bytes handled at once; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
#: Spans up to so many bytes are hashed eight bytes at a time; longer ones by BLAKE2b.
_LONG = 64
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

#: Byte classes of the two word definitions; every byte of a non-ASCII character is a word byte.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32



def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets begin at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        wide = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
        column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Yield (first row, past row, bytes, offsets) of runs of rows of about limit bytes."""
    n, first = len(offsets) - 1, 0
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, past, data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
        first = past


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first span of each row) of the maximal runs of member bytes within rows."""
    if not len(member):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    begin, stop = member.copy(), member.copy()
    begin[1:] &= ~member[:-1]
    stop[:-1] &= ~member[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begin[inner] = member[inner]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stop[last] = member[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span: eight bytes at a time are mixed in, with the length at first."""
    n = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix((eight[starts] & _FIRST_BYTES[np.minimum(n, 8)]) ^ n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero(n > 8)
    for at in range(8, _LONG, 8):
        if not len(left):
            break
        h[left] = mix(h[left] * np.uint64(0xD6E8FEB86659FD93) + (eight[starts[left] + at] & _FIRST_BYTES[np.minimum(n[left] - at, 8)]))
        left = left[n[left] > at + 8]
    for k in left.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether each span has the same bytes as the span at the place in others."""
    n = ends - starts
    if not (n == n[others]).all():
        return False
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for first in range(0, len(n), 1 << 18):
        left, at = np.flatnonzero((n > 0)[first : first + (1 << 18)]) + first, 0
        while len(left):
            one, two = eight[starts[left] + at], eight[starts[others[left]] + at]
            if ((one ^ two) & _FIRST_BYTES[np.minimum(n[left] - at, 8)]).any():
                return False
            at += 8
            left = left[n[left] > at]
            if at == 4 * _LONG:
                view = memoryview(padded)
                if not all(view[starts[k] : ends[k]] == view[starts[others[k]] : ends[others[k]]] for k in left.tolist()):
                    return False
                break
    return True


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every run of k consecutive words that lies in one row; first: as of spans()."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, step = np.zeros(n, np.uint64), 1
    for j in range(k):
        h += hashes[j : j + n] * np.uint64(step)
        step = step * 0xD6E8FEB86659FD93 & _MASK
    ok = np.ones(n + k - 1, bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[cut >= 0]] = False
    at = np.flatnonzero(ok[:n])
    return at, mix(h[at] + np.uint64(k))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of each value in them), by hashing; for values of which many are equal."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank[codes]


def sorted_set(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


#: Weights from here on count as equal in ranked(), the same in every batch.
TOP_WEIGHT = (1 << 20) - 1


def ranked(group: np.ndarray, weight: np.ndarray, place: np.ndarray, n_places: int) -> np.ndarray:
    """place in the order of (group, weight up to TOP_WEIGHT, place).

    Keys are sorted by value, which is several times as fast as sorting places.
    """
    low, high = max(1, int(n_places).bit_length()), max(1, int(group.max(initial=0)).bit_length())
    weight = np.minimum(weight, TOP_WEIGHT)
    if low + high + 20 > 63:
        return place[np.lexsort((place, weight, group))]
    return np.sort(group << (low + 20) | weight << low | place) & ((1 << low) - 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as zstd over byte planes; each array is led by its length and width."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = np.array([len(a), a.dtype.itemsize], np.uint32).tobytes()
        out.append(head + a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack(), unsigned."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, np.uint32, 2, at)
        planes = np.frombuffer(raw, np.uint8, int(n) * int(width), at + 8).reshape(int(width), int(n))
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += 8 + int(n) * int(width)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds its values."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[start : start + length] over all pairs."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    before = np.cumsum(lengths) - lengths
    return values[np.arange(total) + np.repeat(starts - before, lengths)]


def byte_hash(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as the signed integers that Spark holds."""
    return h.view(np.int64)


def trim() -> None:
    """Gives memory that is free but still held by this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def _find_libc():
    try:
        out = ctypes.CDLL("libc.so.6")
        out.malloc_trim  # noqa: B018
    except (OSError, AttributeError):  # another C library, which has no such call
        return None
    return out


_libc = _find_libc()
