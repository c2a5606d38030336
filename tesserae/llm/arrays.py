"""Arrow strings as numpy bytes, and vectorised work on them.

Texts reach Python in Arrow batches. Everything here runs on the bytes of a whole slice of a batch
at once; no Python loop visits single rows, words or characters. Slices are bounded by bytes, so a
batch with very long texts doesn't multiply the memory a worker needs; one text is never divided.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1_000_000

#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes that make words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3 * 2 + 1)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """The column as one string array with 32-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def buffers(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets into data, data); a null row is empty. offsets[0] is 0."""
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def release() -> None:
    """Gives memory that Python and Arrow no longer use back to the system: a worker is used again
    and again, and what it keeps adds to the executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(column: pa.StringArray, most: int = SLICE_BYTES) -> Iterator[pa.StringArray]:
    """Consecutive slices of whole rows, of about `most` bytes each."""
    offsets, _ = buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield column.slice(at, to - at)
        at = to
    release()


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a row's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(len(mask), bool)
    after[-1], after[:-1] = False, mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each position lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        step = out[filled - 1] * base
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_PRIME), -1, 2**64))
            with np.errstate(over="ignore"):
                self.up, self.down = _powers(_PRIME, n), _powers(inverse, n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_LUT = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of consecutive spans (in order of their places) that lie within about SLICE_BYTES."""
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        yield at, to
        at = to


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they lie.

    Prefix sums of byte values times powers of an odd base, brought back to the span's start by the
    inverse power: all spans in a few passes over the bytes. Long data is taken a block of spans at a
    time, for there are several words of memory for each byte.
    """
    if len(data) > 2 * SLICE_BYTES and len(starts) > 1:
        out = np.empty(len(starts), np.uint64)
        for a, z in _blocks(starts, ends):
            out[a:z] = hash_spans(data[starts[a] : ends[z - 1]], starts[a:z] - starts[a], ends[a:z] - starts[a])
        return out
    with np.errstate(over="ignore"):
        up, down = _POWERS.get(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LUT[data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def gather_ragged(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates values[bounds[w]:bounds[w + 1]] for each w; returns (concatenation, its bounds)."""
    lengths = (bounds[1:] - bounds[:-1])[which]
    to = np.zeros(len(which) + 1, np.int64)
    np.cumsum(lengths, out=to[1:])
    index = np.arange(to[-1], dtype=np.int64) + np.repeat(bounds[which] - to[:-1], lengths)
    return values[index], to


def distinct(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings among data[offsets[i]:offsets[i + 1]]: (code of each, offsets and bytes of the distinct)."""
    column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    encoded = column.dictionary_encode()
    words = encoded.dictionary
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64), np.frombuffer(words.buffers()[2] or b"", np.uint8)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes, concatenated: (offsets, bytes). By blocks, as an index is eight times the bytes."""
    lengths = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=to[1:])
    out = np.empty(to[-1], np.uint8)
    at = 0
    while at < len(starts):
        z = max(at + 1, int(np.searchsorted(to, to[at] + SLICE_BYTES, "right")) - 1)
        out[to[at] : to[z]] = data[np.arange(to[z] - to[at], dtype=np.int64) + np.repeat(starts[at:z] - to[at:z] + to[at], lengths[at:z])]
        at = z
    return to, out
