"""Numpy views of Arrow text columns: words, hashes and windows without per-word Python.

Texts stay UTF-8 bytes. White space is \\x20 and \\x09-\\x0D, which never occur inside a
multi-byte character, so words can be cut on bytes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is still handled whole.
SLICE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


#: What a worker drops when a task is done.
AT_END: list[Callable[[], None]] = []


def trim() -> None:
    """Give memory back: workers live on between tasks, beside their executor's JVM."""
    for drop in AT_END:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def sliced(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, done: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches whose text holds about `limit` bytes, or one row; after the last, if `done`, memory is trimmed."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    if done:
        trim()


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    last[off[1:]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside
    ends[:-1] &= ~ends[1:] | last[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of independent polynomial hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, np.ndarray] = {}


def _powers(which: int, n: int) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        have = np.cumprod(np.full(max(256, n), BASES[which], np.uint64))
        _POWERS[which] = have
    return have


#: Bytes of a word from which it is hashed byte by byte, in one sweep, and masks of the first n bytes of eight.
LONG_WORD = 512
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def heads(view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word, zeros after a shorter one; view: `eights`."""
    return view[start] & _FIRST[np.minimum(size, 8)]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size, view = end - start, eights(data)
    own, other = BASES[which], BASES[1 - which]
    out = mix(heads(view, start, size) + size.astype(np.uint64) * other)
    left, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(left):
        out[left] = mix(out[left] * own + heads(view, start[left] + done, size[left] - done))
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        value = data[start[i] : end[i]].astype(np.uint64) + np.uint64(1)
        value *= np.cumprod(np.full(len(value), own, np.uint64))
        out[i] = mix(value.sum(dtype=np.uint64, keepdims=True) + size[i : i + 1].astype(np.uint64) * other)[0]
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, code point) of each character of UTF-8 bytes."""
    if not (data >= 128).any():
        return np.arange(len(data)), data.astype(np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    code = lead.astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, more, mark in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        wide = np.flatnonzero((lead >= low) & (lead < high))
        value = code[wide] & mark
        for j in range(1, more + 1):
            value = value << 6 | (padded[at[wide] + j] & 0x3F)
        code[wide] = value
    return at, code


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each i, count[i] of them, one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def window_hashes(word: np.ndarray, doc: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every run of k words within one document."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = _powers(which, k)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += word[j : j + n] * step[j]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(total[at]), at
