"""Word and shingle hashing straight from Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the
same as `[^\\x20\\x09-\\x0D]+` on the decoded text because every separator is
ASCII.  Hashes are 64-bit: a tabulated polynomial over the bytes, finished with
a mixing step.  Work is done in blocks of a few megabytes that end between
words, so memory stays bounded for any batch and any length of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        inverse = pow(int(_ODD), -1, 2**64)
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, np.uint64(inverse), np.uint64)
        up[0] = down[0] = 1
        found = np.cumprod(up), np.cumprod(down)
        if size > 4 * BLOCK_BYTES:
            return found
        _POWERS["up"], _POWERS["down"] = found
    return _POWERS["up"], _POWERS["down"]


def _hash_block(data: np.ndarray, breaks: np.ndarray, table: np.ndarray, heads: tuple[int, ...] = (), tails: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of one block (a row per head and tail length follows the words'), and where each word starts in it."""
    n = len(data)
    word = ~_SEPARATOR[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[breaks] = True
    starts = np.flatnonzero(word & first)
    if not len(starts):
        return np.zeros((1 + len(heads) + len(tails), 0), np.uint64), starts
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~word[1:]
    ends = np.flatnonzero(word & last) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], out=sums[1:])
    def part(lo: np.ndarray, hi: np.ndarray, kind: int) -> np.ndarray:
        h = (sums[hi] - sums[lo]) * down[lo]
        return mix(h + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind))

    rows = [part(starts, ends, 0)]
    rows += [part(starts, np.minimum(ends, starts + k), 1) for k in heads]
    rows += [part(np.maximum(starts, ends - k), ends, 2) for k in tails]
    return np.stack(rows), starts


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        return text_buffers(column.cast(pa.string()))
    rows, _, = len(column), None
    bufs = column.buffers()
    if not rows or bufs[1] is None:
        return np.zeros(rows + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(bufs[1], kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each row's words in them)."""
    h, at = word_parts(column, lower)
    return h[0], at


def word_parts(column: pa.Array, lower: bool = True, heads: tuple[int, ...] = (), tails: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Like word_hashes with more rows: hashes of the words' first and last so many bytes."""
    offsets, data = text_buffers(column)
    table = _LOWER if lower else _TABLE
    found, places = [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK_BYTES)
        if to < n:
            back = data[max(at, to - 65536) : to]
            cut = np.flatnonzero(_SEPARATOR[back])
            if len(cut):
                to = to - len(back) + int(cut[-1]) + 1
            else:  # a very long word: end at the next separator or row
                row_end = int(offsets[np.searchsorted(offsets, to, "left")])
                rest = np.flatnonzero(_SEPARATOR[data[to:row_end]])
                to = to + int(rest[0]) + 1 if len(rest) else row_end
        lo, hi = np.searchsorted(offsets, at, "left"), np.searchsorted(offsets, to, "left")
        breaks = offsets[lo:hi] - at
        h, starts = _hash_block(data[at:to], breaks, table, heads, tails)
        found.append(h)
        places.append(starts + at)
        at = to
    if not found:
        return np.zeros((1 + len(heads) + len(tails), 0), np.uint64), np.zeros(len(offsets), np.int64)
    place = np.concatenate(places)
    return np.concatenate(found, axis=1), np.searchsorted(place, offsets, "left")


_STEPS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a row's shingles; fewer words make one shingle."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    w = min(width, n)
    out = h[: n - w + 1] * _STEPS[0]
    for j in range(1, w):
        out = out + h[j : n - w + 1 + j] * _STEPS[j]
    out = mix(out + np.uint64(w))
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]
