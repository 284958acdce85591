"""Lossless WebP: a decoder and an encoder of the format, and operators that store texts and read image files.

The decoder reads prefix codes, back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms.  It
follows the published bitstream specification; codes are read by table.  The
encoder stores bytes as green samples: a palette of the bytes that occur (packed
several to a pixel when they are few), back-references to earlier repeats, and
prefix codes of the rest.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a row of stored payloads, one for each byte.
UNIT = 576
MOST_ROWS = 16384
#: Bytes by which repeats are found, the shortest repeat that is worth a back-reference, and the longest that one code can copy.
LEAST_MATCH = 8
WORTH = 14
MOST_MATCH = 4096
#: Longest prefix code that the encoder makes.
LONGEST_CODE = 11
#: Bytes of a stream that the decoder looks codes up in at a time.
WINDOW = 1 << 16

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) offsets of the 120 nearest distance codes.
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
def _turned_table() -> list[int]:
    """Every number of 15 bits with its bits in reverse."""
    n, out = np.arange(1 << 15), np.zeros(1 << 15, np.int64)
    for i in range(15):
        out |= (n >> i & 1) << 14 - i
    return out.tolist()


_TURNED = _turned_table()


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        lo = self.at >> 3
        got = int.from_bytes(self.data[lo : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        return got


class Code:
    """A canonical prefix code given by its lengths: a table of (symbol, length) by the next `longest` bits."""

    def __init__(self, lengths: list[int]):
        used = sorted([(n, s) for s, n in enumerate(lengths) if n])
        self.only = (used[0][1] if used else 0) if len(used) < 2 else None
        self.longest = 0 if self.only is not None else used[-1][0]
        if self.only is not None:
            self.table = [self.only << 4]
            return
        size = 1 << self.longest
        table = [-1] * size
        code, last = 0, 0
        for n, symbol in used:
            code <<= n - last
            last = n
            if code >= 1 << n:
                raise ValueError("a prefix code is over-full")
            table[_TURNED[code] >> 15 - n :: 1 << n] = [symbol << 4 | n] * (size >> n)
            code += 1
        if code != 1 << last:
            raise ValueError("a prefix code is not complete")
        self.table = table

    @classmethod
    def simple(cls, symbols: list[int]) -> Code:
        """A code of one symbol, or of two in ascending order."""
        self = cls.__new__(cls)
        self.only = symbols[0] if len(symbols) == 1 else None
        self.longest = len(symbols) - 1
        self.table = [symbols[0] << 4] if len(symbols) == 1 else [s << 4 | 1 for s in symbols]
        return self

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        lo = bits.at >> 3
        entry = self.table[int.from_bytes(bits.data[lo : lo + 4], "little") >> (bits.at & 7) & (1 << self.longest) - 1]
        bits.at += entry & 15
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        return entry >> 4


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        count = bits.read(1) + 1
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if count == 2:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise ValueError("a symbol outside its alphabet")
        return Code.simple(sorted(set(symbols)))
    lengths = [0] * alphabet
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    done, before, start = 0, 8, bits.at
    held = int.from_bytes(bits.data[start >> 3 : (start >> 3) + 2 * alphabet + 8], "little") >> (start & 7)
    table, low, used = code.table, (1 << code.longest) - 1, 0
    while done < alphabet and left:
        left -= 1
        entry = table[held & low]
        n = 0 if code.only is not None else entry & 15
        held >>= n
        used += n
        symbol = entry >> 4
        if symbol < 16:
            lengths[done] = symbol
            done += 1
            before = symbol or before
            continue
        extra = (2, 3, 7)[symbol - 16]
        times = (3, 3, 11)[symbol - 16] + (held & (1 << extra) - 1)
        held >>= extra
        used += extra
        if done + times > alphabet:
            raise ValueError("too many code lengths")
        if symbol == 16:
            lengths[done : done + times] = [before] * times
        done += times
    bits.at = start + used
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return Code(lengths)


def _length(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB values of one entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, meta, shift = 1, None, 0
    if top and bits.read(1):
        shift = bits.read(3) + 2
        meta = (_read_pixels(bits, width + (1 << shift) - 1 >> shift, height + (1 << shift) - 1 >> shift, False) >> 8 & 0xFFFF).astype(int)
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        r, b, a = (c.only for c in codes[0][1:4])
        read = _read_one_channel if top else _one_by_one
        return read(bits, codes[0][0], codes[0][4], width, total).astype(np.uint32) << np.uint32(8) | np.uint32(a << 24 | r << 16 | b)
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    known = 0  # pixels that are in the cache so far; it is filled when a code of it comes
    across = width + (1 << shift) - 1 >> shift
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, far = codes[meta[(at // width >> shift) * across + (at % width >> shift)] if meta is not None else 0]
        symbol = green.read(bits)
        if symbol < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | symbol << 8 | b)
        elif symbol < 280:
            n = _length(symbol - 256, bits)
            _copy(out, _distance(_length(far.read(bits), bits), width), n, total)
        else:
            for v in out[known:]:
                cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> 32 - cache_bits] = v
            known = at
            out.append(cache[symbol - 280])
    return np.array(out, np.uint32)


def _distance(code: int, width: int) -> int:
    """How many pixels back a distance code points: the first 120 are places near the pixel."""
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


@lru_cache(maxsize=16)
def _near_codes(width: int) -> dict[int, int]:
    """The least near code of each distance that has one."""
    return {_distance(c, width): c for c in range(120, 0, -1)}


def _copy(out, back: int, n: int, total: int) -> None:
    """Append n pixels from `back` places before the end, which may overlap what is appended."""
    at = len(out)
    if back > at or at + n > total:
        raise ValueError("a back-reference leaves the image")
    piece = out[at - back : at - back + n]
    while len(piece) < n:
        piece = piece + piece
    out += piece[:n]


def _several(code: Code) -> np.ndarray:
    """The code's table with as many literals in an entry as its bits hold, three at most: literals << 8 | their number << 4 | bits; 0 for other symbols."""
    one = np.array(code.table, np.int32)
    literal, total, count, out = one < 4096, one & 15, np.ones(len(one), np.int32), one >> 4
    place = np.arange(len(one), dtype=np.int32)
    for more in (1, 2):
        after = one[place >> total]
        reach = total + (after & 15)
        ok = literal & (after < 4096) & (reach <= code.longest)
        if more == 2:
            ok &= count == 2
        out += (after >> 4 << 8 * more) * ok
        count += ok
        total = np.where(ok, reach, total)
    return (out << 8 | count << 4 | total) * literal


#: Bits that a step from the last bit of a block may lead beyond it, four steps of 15 bits.
_BEYOND = 64
_BITS = np.arange(8 * WINDOW + _BEYOND, dtype=np.int32)


def _twice(step: np.ndarray) -> np.ndarray:
    """The length of two steps in a row from every bit; 0 where one of them is none. Steps are followed by _BEYOND zeros."""
    n = len(step) - _BEYOND
    first = step[:n]
    then = step[_BITS[:n] + first]
    out = np.zeros(len(step), np.int32)
    np.multiply(first + then, (first > 0) & (then > 0), out=out[:n])
    return out


def _one_by_one(bits: Bits, green: Code, far: Code, width: int, total: int) -> np.ndarray:
    """Green values of an image that more of the stream follows."""
    out = bytearray()
    while len(out) < total:
        symbol = green.read(bits)
        if symbol < 256:
            out.append(symbol)
        elif symbol < 280:
            n = _length(symbol - 256, bits)
            _copy(out, _distance(_length(far.read(bits), bits), width), n, total)
        else:
            raise ValueError("a colour cache code without a cache")
    return np.frombuffer(out, np.uint8)


def _read_one_channel(bits: Bits, green: Code, far: Code, width: int, total: int) -> np.ndarray:
    """Green values of the last image of a stream, whose other channels are constant and that has no colour cache.

    What the code reads at every bit of a block is looked up at once; then one pass
    goes from symbol to symbol, notes where literals start and reads references.
    In the end the literals are laid out and the references copied in their order.
    """
    if green.only is not None:
        if green.only > 255:
            raise ValueError("a back-reference leaves the image")
        return np.full(total, green.only, np.uint8)
    data, end = bits.data, 8 * len(bits.data)
    low, several, table = (1 << green.longest) - 1, _several(green), green.table
    far_table, far_low = far.table, (1 << far.longest) - 1
    tokens: list[np.ndarray] = []
    refs: list[tuple[int, int, int]] = []  # tokens before it, length, distance
    before, at, shifts = 0, bits.at, np.arange(8, dtype=np.uint32)
    while at < end:
        lo = at >> 3
        raw = np.frombuffer(data[lo : lo + WINDOW] + b"\0\0\0", np.uint8).astype(np.uint32)
        word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16)
        entry = several[(word[:, None] >> shifts).ravel() & low]
        stop = min(8 * len(word), end - 8 * lo)
        one = np.zeros(len(entry) + _BEYOND, np.int32)
        np.bitwise_and(entry, 15, out=one[: len(entry)])
        far_step, step = memoryview(_twice(_twice(one))), memoryview(one)
        p, found, leaps = at & 7, [], []
        add, leap = found.append, leaps.append
        while p < stop:
            n = far_step[p]
            if n:
                leap(p)
                p += n
                continue
            n = step[p]
            if n:
                add(p)
                p += n
                continue
            at = 8 * lo + p
            held = int.from_bytes(data[at >> 3 : (at >> 3) + 10], "little") >> (at & 7)
            code = table[held & low]
            n = code & 15
            prefix = (code >> 4) - 256
            if prefix >= 24:
                raise ValueError("a colour cache code without a cache")
            held >>= n
            p += n
            if prefix < 4:
                size = prefix + 1
            else:
                extra = prefix - 2 >> 1
                size = ((2 + (prefix & 1)) << extra) + (held & (1 << extra) - 1) + 1
                held >>= extra
                p += extra
            code = far_table[held & far_low]
            n = code & 15
            held >>= n
            p += n
            prefix = code >> 4
            if prefix < 4:
                back = prefix + 1
            else:
                extra = prefix - 2 >> 1
                back = ((2 + (prefix & 1)) << extra) + (held & (1 << extra) - 1) + 1
                p += extra
            refs.append((before + len(found) + 4 * len(leaps), size, back - 120 if back > 120 else _distance(back, width)))
        quads = [np.array(leaps, np.int64)]
        for _ in range(3):
            quads.append(quads[-1] + one[quads[-1]])
        tokens.append(entry[np.sort(np.concatenate([np.array(found, np.int64), *quads]))])
        before += len(tokens[-1])
        at = 8 * lo + p
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    count = token >> 4 & 15
    first = np.append(0, np.cumsum(count, dtype=np.int64))
    n, size, back = np.array(refs, np.int64).reshape(-1, 3).T
    to = first[n] + np.cumsum(size) - size
    inside = to < total  # spare bits after the image may look like more
    n, size, back, to = n[inside], size[inside], back[inside], to[inside]
    if (back > to).any() or (to + size > total).any():
        raise ValueError("a back-reference leaves the image")
    if int(first[-1]) + int(size.sum()) < total:
        raise ValueError("the stream ends early")
    gap = np.bincount(n, size, minlength=len(token) + 1).astype(np.int64)
    place = first[:-1] + np.cumsum(gap)[: len(token)]
    flat = np.zeros(total + 2, np.uint8)
    for i in range(3):
        some = np.flatnonzero((count > i) & (place + i < total))
        flat[place[some] + i] = token[some] >> 8 * i + 8 & 255
    out = bytearray(flat[:total])
    for at, length, far_ in zip(to.tolist(), size.tolist(), back.tolist(), strict=True):
        if far_ >= length:
            out[at : at + length] = out[at - far_ : at - far_ + length]
        else:
            out[at : at + length] = (bytes(out[at - far_ : at]) * (length // far_ + 1))[:length]
    bits.at = end
    return np.frombuffer(out, np.uint8)


def _planes(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p).astype("<u4").view(np.uint8).reshape(*p.shape, 4)


def _average(a, b):
    return [x + y >> 1 for x, y in zip(a, b, strict=True)]


def _predict(mode: int, left, top, corner, right):
    """The value predicted for a pixel from its neighbours, by channel."""
    clamp = lambda v: max(0, min(255, v))
    if mode == 0:
        return [0, 0, 0, 255]
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _average(corner if mode == 8 else top, top if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        mean = _average(left, top)
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]
    return [0, 0, 0, 255]


def _undo_predictor(p: np.ndarray, width: int, modes: np.ndarray, shift: int) -> np.ndarray:
    px = _planes(p.reshape(-1, width)).astype(int).tolist()
    across = width + (1 << shift) - 1 >> shift
    for y, row in enumerate(px):
        for x in range(width):
            if not x and not y:
                guess = [0, 0, 0, 255]
            elif not y:
                guess = row[x - 1]
            elif not x:
                guess = px[y - 1][0]
            else:
                mode = int(modes[(y >> shift) * across + (x >> shift)]) >> 8 & 15
                above = px[y - 1]
                guess = _predict(mode, row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < width else row[0])
            row[x] = [v + g & 255 for v, g in zip(row[x], guess, strict=True)]
    return np.array(px, np.uint8).reshape(-1, 4).view("<u4").ravel()


def _undo_cross_colour(p: np.ndarray, width: int, factors: np.ndarray, shift: int) -> np.ndarray:
    at = np.arange(len(p))
    across = width + (1 << shift) - 1 >> shift
    f = _planes(factors[(at // width >> shift) * across + (at % width >> shift)]).view(np.int8).astype(int)
    px = _planes(p).astype(int)
    signed = lambda v: ((v & 255) ^ 128) - 128
    green = signed(px[:, 1])
    red = px[:, 2] + (f[:, 0] * green >> 5) & 255
    blue = px[:, 0] + (f[:, 1] * green >> 5) + (f[:, 2] * signed(red) >> 5) & 255
    return np.stack([blue, px[:, 1], red, px[:, 3]], 1).astype(np.uint8).view("<u4").ravel()


def _undo_palette(p: np.ndarray, width: int, packed: int, height: int, palette: np.ndarray, shift: int) -> np.ndarray:
    index = (p >> 8 & 255).astype(int).reshape(height, packed)
    if shift:
        per, size = 1 << shift, 8 >> shift
        x = np.arange(width)
        index = index[:, x >> shift] >> (x & per - 1) * size & (1 << size) - 1
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index].ravel()


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels as unsigned 32-bit integers) of one file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a simple lossless file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            shift = bits.read(3) + 2
            tiles = _read_pixels(bits, inner + (1 << shift) - 1 >> shift, height + (1 << shift) - 1 >> shift, False)
            undo.append((_undo_predictor if kind == 0 else _undo_cross_colour, (inner, tiles, shift)))
        elif kind == 2:
            undo.append((lambda p: _planes(p), ()))
        else:
            n = bits.read(8) + 1
            palette = np.add.accumulate(_planes(_read_pixels(bits, n, 1, False)), axis=0, dtype=np.uint8).view("<u4").ravel()
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            packed = inner + (1 << shift) - 1 >> shift
            undo.append((_undo_palette, (inner, packed, height, palette, shift)))
            inner = packed
    p = _read_pixels(bits, inner, height, True)
    for f, args in reversed(undo):
        p = f(p, *args)
        if p.ndim == 2:  # green was subtracted from red and blue
            p[:, 0] += p[:, 1]
            p[:, 2] += p[:, 1]
            p = p.view("<u4").ravel()
    return width, height, p


class BitWriter:
    """Writes little-endian bits."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Lengths of a prefix code of least total length; where one is too long, rare symbols count as more frequent."""
    used = [(c, s) for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for _, s in used:
            out[s] = 1
        return out
    floor, many = 1, len(used)
    while True:
        heap = [(c if c > floor else floor, i) for i, (c, _) in enumerate(used)]
        heapq.heapify(heap)
        parent = [0] * (2 * many - 1)
        for node in range(many, 2 * many - 1):
            c, i = heapq.heappop(heap)
            d, j = heapq.heapreplace(heap, (c + heap[0][0], node))
            parent[i] = parent[j] = node
        depth = [0] * (2 * many - 1)
        for node in range(2 * many - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= longest:
            break
        floor *= 2
    for i, (_, s) in enumerate(used):
        out[s] = depth[i]
    return out


def code_bits(lengths: list[int]) -> np.ndarray:
    """The bits of each symbol of a canonical code, first bit lowest."""
    out = [0] * len(lengths)
    code, last = 0, 0
    for n, s in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - last
        last = n
        out[s] = _TURNED[code] >> 15 - n
        code += 1
    return np.array(out, np.int64)


def _put_code(w: BitWriter, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Write a code for these counts; (bits, length) of each symbol."""
    used = [s for s, c in enumerate(counts) if c] or [0]
    if len(used) < 3 and used[-1] < 256:  # a simple code
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        bits, size = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        if len(used) == 2:
            size[used], bits[used[1]] = 1, 1
        return bits, size
    if len(used) == 1:  # two codes of one bit, as a simple code holds no symbol beyond 255
        counts = [int(s in (0, used[0])) for s in range(len(counts))]
    lengths = code_lengths(counts, LONGEST_CODE)
    tokens = []  # (symbol of the code-length code, extra bits, their number)
    for value, same in groupby(lengths):
        run = len(list(same))
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= 3:
            n = min(run, 6 if value else 138 if run > 10 else 10)
            tokens.append((16, n - 3, 2) if value else (17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            run -= n
        tokens += [(value, 0, 0)] * run
    seen = [0] * 19
    for t, _, _ in tokens:
        seen[t] += 1
    first = code_lengths(seen, 7)
    order = [first[s] for s in CODE_LENGTH_ORDER]
    count = max(4, max(i for i, n in enumerate(order) if n) + 1)
    w.put(0, 1)
    w.put(count - 4, 4)
    for n in order[:count]:
        w.put(n, 3)
    w.put(0, 1)
    bits = code_bits(first).tolist()
    single = sum(n > 0 for n in first) == 1
    for t, extra, n in tokens:
        if not single:
            w.put(bits[t], first[t])
        w.put(extra, n)
    return code_bits(lengths), np.array(lengths)


def _put_one(w: BitWriter, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    w.put(5, 3)
    w.put(symbol, 8)


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, their number) of lengths or distance codes from 1 on."""
    v = v.astype(np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1)), np.where(v < 4, 0, v & (1 << extra) - 1), extra


def _repeats(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of back-references to the last earlier place of the same LEAST_MATCH pixels, taken from the left."""
    none = np.zeros(0, np.int64)
    n = len(px) - LEAST_MATCH + 1
    if n < 2:
        return none, none, none
    key = px.astype(np.uint64)
    for j in (1, 2, 4):  # eight bytes from every place
        key = key[:-j] | key[j:] << np.uint64(8 * j)
    # a stable sort of sixteen bits is by radix; places whose hashes meet by chance are told apart by their keys
    order = np.argsort((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    back = np.zeros(n, np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    back[back > (1 << 20) - 120] = 0
    ends = np.append(np.flatnonzero(back[1:] != back[:-1]) + 1, n)
    until = np.repeat(ends, np.diff(np.append(0, ends))) + LEAST_MATCH - 1
    worth = (back > 0) & (until - np.arange(n) >= WORTH)
    places = np.flatnonzero(worth)
    if not len(places):
        return none, none, none
    follow = np.full(len(px) + 2, len(places), np.int64)  # how many places lie before each
    np.cumsum(worth, out=follow[1 : n + 1])
    follow[0] = 0
    follow = memoryview(follow)
    where, stop = places.tolist(), until[places].tolist()
    out, i = [], 0
    while i < len(where):
        out.append(i)
        i = follow[min(stop[i], where[i] + MOST_MATCH)]
    at = places[out]
    return at, np.minimum(until[at] - at, MOST_MATCH), back[at]


def _image(w: BitWriter, px: np.ndarray, width: int) -> bytes:
    """What follows `w`: green values in prefix codes with back-references; red and blue 0, alpha 255."""
    at, size, back = _repeats(px)
    near = _near_codes(width)
    far = np.array([near.get(d, d + 120) for d in back.tolist()], np.int64)
    covered = np.zeros(len(px) + 1, np.int64)
    covered[at] += 1
    covered[at + size] -= 1
    literal = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    length, length_extra, length_bits = _prefixed(size)
    dist, dist_extra, dist_bits = _prefixed(far)
    w.put(0, 1)  # no colour cache: literals of one channel gain nothing by it
    w.put(0, 1)  # one group of codes
    green, green_bits = _put_code(w, np.bincount(np.concatenate((px[literal].astype(np.int64), length + 256)), minlength=280).tolist())
    for value in (0, 0, 255):
        _put_one(w, value)
    code, code_bits_ = _put_code(w, np.bincount(dist, minlength=40).tolist())
    fields = [(green[length + 256], green_bits[length + 256]), (length_extra, length_bits), (code[dist], code_bits_[dist]), (dist_extra, dist_bits)]
    taken = np.zeros(len(px), np.int64)
    taken[literal] = green_bits[px[literal]]
    taken[at] = sum(n for _, n in fields)
    ends = w.n + np.cumsum(taken)
    total = int(ends[-1])
    start, value, here = [(ends - taken)[literal]], [green[px[literal]]], (ends - taken)[at]
    for v, n in fields:
        start.append(here)
        value.append(v)
        here = here + n
    start, value = np.concatenate(start), np.concatenate(value)
    out = np.zeros((total + 7 >> 3) + 4)
    spread = value << (start & 7)
    for j in range(4):
        out += np.bincount((start >> 3) + j, (spread >> 8 * j & 255).astype(float), minlength=len(out))
    head = np.frombuffer(w.value.to_bytes(w.n + 7 >> 3, "little"), np.uint8)
    out[: len(head)] += head
    return out[: total + 7 >> 3].astype(np.uint8).tobytes()


def _riff(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + 8 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def _header(width: int, height: int) -> BitWriter:
    w = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def _stored(samples: np.ndarray) -> bytes:
    """One file: samples as green values by a palette."""
    height = len(samples) // UNIT
    seen = np.flatnonzero(np.bincount(samples, minlength=256))
    number = np.zeros(256, np.uint8)
    number[seen] = np.arange(len(seen))
    w = _header(UNIT, height)
    w.put(1, 1)
    w.put(3, 2)
    w.put(len(seen) - 1, 8)
    w.put(0, 1)  # the palette is an image of differences, in green; alpha starts at 255 and stays
    steps = np.diff(np.append(0, seen)).tolist()
    green, green_size = (x.tolist() for x in _put_code(w, np.bincount(steps, minlength=280).tolist()))
    _put_one(w, 0)
    _put_one(w, 0)
    alpha, alpha_size = _put_code(w, np.bincount([255] + [0] * (len(steps) - 1), minlength=256).tolist())
    _put_one(w, 0)
    for i, v in enumerate(steps):
        w.put(green[v], green_size[v])
        w.put(int(alpha[0 if i else 255]), int(alpha_size[0 if i else 255]))
    w.put(0, 1)
    index = number[samples]
    shift = 3 if len(seen) <= 2 else 2 if len(seen) <= 4 else 1 if len(seen) <= 16 else 0
    if shift:  # UNIT is a multiple of 8, so rows pack without a rest
        parts = index.reshape(-1, 1 << shift)
        index = sum((parts[:, i] << np.uint8(i * (8 >> shift)) for i in range(1, 1 << shift)), parts[:, 0].copy())
    return _riff(_image(w, index, UNIT >> shift))


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of UNIT bytes as files laid end to end, the green sample of a pixel for each byte."""
    samples = np.frombuffer(payload, np.uint8)
    step = UNIT * MOST_ROWS
    return b"".join(_stored(samples[i : i + step]) for i in range(0, len(samples), step))


def files(media: bytes) -> list[bytes]:
    """The files that are laid end to end."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def pixels(data: bytes) -> np.ndarray:
    """The pixel array (height, width, red green blue alpha) of one file."""
    width, height, p = decode(data)
    return _planes(p)[:, [2, 1, 0, 3]].reshape(height, width, 4)


def restore(media: bytes) -> list[np.ndarray]:
    """Pixel arrays of files laid end to end."""
    return [pixels(x) for x in files(media)]


def padded(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _row(raw: bytes) -> tuple:
    media = store(padded(raw))
    images = restore(media)
    back = b"".join(x[:, :, 1].tobytes() for x in images)
    rows = sum(len(x) for x in images)
    seen = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
    mean = int((seen * np.arange(256)).sum()) * 1000 // len(back)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{UNIT}x{rows}:{int((seen > 0).sum())},{mean}", media


_FIELDS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")


def _run(full: bool):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows = [_row(t.encode("utf-8", "surrogatepass") if t else b"") for t in batch.column(1).to_pylist()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in list(zip(columns, kinds, strict=True))[: 8 if full else 7])], names=["doc_id", *_FIELDS[: 8 if full else 7]])

    return run


def media_column(docs: DataFrame, with_files: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes stored as lossless WebP, read back and described; `media` holds the file itself.

    Null and empty texts store one unit of 255s.  Equal texts give equal values;
    repeated rows are stored one by one; texts beyond MOST_ROWS rows become
    several files end to end; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_run(with_files), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_files)


def decoded_column(images: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, width, height, pixels, error) of every row of a binary column of lossless WebP files.

    `pixels` holds the rows of the pixel array from the top, four samples (red,
    green, blue, alpha) a pixel.  A null file gives nulls; a file that is broken or
    of another kind gives its error and no pixels.  Repeated rows are decoded one
    by one; other columns are ignored.
    """

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None
        try:
            got = pixels(data)
        except (ValueError, IndexError) as e:
            return None, None, None, str(e)
        return got.shape[1], got.shape[0], got.tobytes(), None

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                batch = whole.slice(at, 16)
                columns = list(zip(*[one(x) for x in batch.column(1).to_pylist()], strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=["doc_id", "width", "height", "pixels", "error"])

    slim = images.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return slim.mapInArrow(run, "doc_id long, width int, height int, pixels binary, error string")


def op7_webp(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole documents table."""
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_files=False)
