"""Vectorised work on the UTF-8 bytes of many texts at once: words, their hashes, shingles."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 4 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Words longer than this many bytes are hashed one by one.
_LONG = 4096


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@cache
def _libc() -> ctypes.CDLL | None:
    found = ctypes.util.find_library("c")
    libc = ctypes.CDLL(found) if found else None
    return libc if libc is not None and hasattr(libc, "malloc_trim") else None


def release() -> None:
    """Give freed memory back: workers live on after a task, and many share a machine."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of rows of about ``size`` bytes."""
    data, offsets = strings(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without visible structure."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin and end among them."""
    inside = ~_WS[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), 0, (1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = mix(h ^ (eight[starts] & _LOW[np.minimum(length, 8)]))
    left = np.flatnonzero((length > 8) & (length <= _LONG))
    done = 8
    while len(left):
        block = eight[starts[left] + done] & _LOW[np.minimum(length[left] - done, 8)]
        h[left] = mix(h[left] ^ block)
        done += 8
        left = left[length[left] > done]
    for i in np.flatnonzero(length > _LONG):
        word = data[starts[i] : ends[i]]
        blocks = np.zeros(-(-len(word) // 8), "<u8")
        blocks.view(np.uint8)[: len(word)] = word
        place = mix(np.arange(1, len(blocks) + 1, dtype=np.uint64))
        h[i] = mix(np.array([np.bitwise_xor.reduce(mix(blocks ^ place))], np.uint64) ^ h[i])[0]
    return h


def shingles(h: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, and their bounds; a shorter text that has words is one run."""
    if width > 16:
        raise ValueError("width above 16")
    mult = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    count = np.diff(bounds)
    per = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(per, out=out[1:])
    n = len(h)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        total[: n - k] += h[k:] * mult[k]
    # word index of each shingle: words in order, without the last width - 1 of each text
    index = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], per)
    found = total[index]
    for i in np.flatnonzero((count > 0) & (count < width)):
        run = h[bounds[i] : bounds[i + 1]]
        mark = np.array([len(run) * 0xD6E8FEB86659FD93 % (1 << 64)], np.uint64)
        found[out[i] : out[i] + 1] = (run * mult[: len(run)]).sum(dtype=np.uint64, keepdims=True) + mark
    return mix(found), out


def shingle_runs(column: pa.Array, width: int = 5, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, shingle hashes with repeats, and their bounds, of texts with A-Z lower-cased."""
    for first, last, data, offsets in chunks(column, size):
        data = fold(data)
        starts, ends, bounds = words(data, offsets)
        yield first, last, *shingles(word_hashes(data, starts, ends), bounds, width)
