"""Lossless WebP (VP8L): a whole decoder, an encoder for all of its tools, and faster ones for many files at once.

decode() reads any VP8L file: simple and normal prefix codes, prefix-code groups, back-references, colour cache, and the
predictor, cross-colour, subtract-green and palette transforms, and gives the pixel array. encode() writes them, on demand.

Documents are stored as payloads: UTF-8 bytes, then bytes 0 up to a positive multiple of 64, four bytes a pixel. Each file
has the transform that a rule finds best for it, back-references, a colour cache where it is of use, and prefix codes
fitted to it; nothing but the text decides, so equal texts give equal files. Files are written and read many at a time, since
texts are short and a code costs about the same for few symbols as for many; decode_batch() reads any file that decode() reads,
and gives the same. A very long text is one image like any other.

Defined results: null text counts as empty and gives a payload of 64 zeros; repeated rows give equal values; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellumspark.llm.common import texts
from vellumspark.llm.packing import _slices

# Fixed values of the format: the order of code-length code lengths, and the near neighbours of distance codes 1 .. 120.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
_HASH = 0x1E35A7BD
_BLACK = 0xFF000000


# -- bits and prefix codes ---------------------------------------------------------------------------------------------


class Bits:
    """Reads bits, least significant first; past the end they are 0."""

    def __init__(self, data: bytes, at: int = 0):
        self.number, self.at, self.size = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.number[first : first + 5 + (n >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        if self.at > self.size + 64:
            raise ValueError("the file ends too early")
        return value


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0
        self.parts: list[bytes] = []

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n
        while self.at >= 512:
            self.parts.append((self.value & ((1 << 512) - 1)).to_bytes(64, "little"))
            self.value >>= 512
            self.at -= 512

    def bits(self) -> int:
        return 512 * len(self.parts) + self.at

    def bytes(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.at + 7) // 8, "little")


def huffman(weights: list[int], limit: int) -> list[int]:
    """Code lengths of a complete prefix code for the symbols of positive weight; a single symbol has length 1."""
    used = [s for s, w in enumerate(weights) if w > 0]
    lengths = [0] * len(weights)
    if len(used) == 1:
        lengths[used[0]] = 1
    least = 1
    while len(used) > 1:
        heap = [(max(weights[s], least), s, k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        over = [0] * (2 * len(used) - 1)  # the node above each, the last one being the root
        for new in range(len(used), len(over)):
            a, b = heapq.heappop(heap), heap[0]
            over[a[2]] = over[b[2]] = new
            heapq.heapreplace(heap, (a[0] + b[0], a[1], new))
        depth = [0] * len(over)
        for k in range(len(over) - 2, -1, -1):
            depth[k] = depth[over[k]] + 1
        for k, s in enumerate(used):
            lengths[s] = depth[k]
        if max(lengths) <= limit:
            break
        least = max(least + 1, 2 * least, sum(weights) >> limit)
    return lengths


_REVERSED = [int(format(k, "015b")[::-1], 2) for k in range(1 << 15)]
_TURNED = np.array(_REVERSED)


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes, bits reversed as they stand in the stream."""
    out, code, before = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[s] = _REVERSED[code] >> (15 - n)
        code += 1
    return out


class Code:
    """A prefix code's lookup: for each next ``width`` bits, symbol << 4 | length. One symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            used, lengths = [0], [1] + lengths[1:]
        self.only = used[0] if len(used) == 1 else None
        self.width = 0 if self.only is not None else max(lengths)
        self.table = np.zeros(1 << self.width, np.int32)
        if self.only is not None:
            self.table[0] = self.only << 4
        else:
            if sum(1 << (self.width - lengths[s]) for s in used) != 1 << self.width:
                raise ValueError("an incomplete prefix code")
            found = codes(lengths)
            for s in used:
                self.table[found[s] :: 1 << lengths[s]] = s << 4 | lengths[s]
        self.list = self.table.tolist()

    def read(self, bits: Bits) -> int:
        found = self.list[bits.peek(self.width)] if self.width else self.list[0]
        bits.at += found & 15
        return found >> 4


def read_code(bits: Bits, size: int) -> list[int]:
    """Code lengths of an alphabet."""
    lengths = [0] * size
    if bits.read(1):  # simple
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[_LENGTH_ORDER[k]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    data, place, table, mask = bits.number, bits.at, code.list, (1 << code.width) - 1
    while at < size and left:
        left -= 1
        window = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        s = table[window & mask]
        n = s & 15
        s >>= 4
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            value, least, extra = ((before, 3, 2), (0, 3, 3), (0, 11, 7))[s - 16]
            times = least + (window >> n & ((1 << extra) - 1))
            n += extra
            if at + times > size:
                raise ValueError("too many code lengths")
            lengths[at : at + times] = [value] * times
            at += times
        place += n
    bits.at = place
    if place > bits.size + 64:
        raise ValueError("the file ends too early")
    return lengths


def write_code(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(1, 1)
        for s in used:
            out.write(s, 8)
        return
    symbols: list[tuple[int, int, int]] = []  # code-length symbol, extra value, extra bits
    for value, same in groupby(lengths):
        left = len(list(same))
        while left:
            run = left
            if value == 0 and run >= 3:
                run = min(run, 138)
                symbols.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
            elif value and run >= 4:
                run = min(run, 7)
                symbols += [(value, 0, 0), (16, run - 4, 2)]
            else:
                run = 1
                symbols.append((value, 0, 0))
            left -= run
    weights = [0] * 19
    for s, _, _ in symbols:
        weights[s] += 1
    own = huffman(weights, 7)
    own_codes = codes(own)
    out.write(0, 1)
    last = max(k for k in range(19) if own[_LENGTH_ORDER[k]])
    n = max(4, last + 1)
    out.write(n - 4, 4)
    for k in range(n):
        out.write(own[_LENGTH_ORDER[k]], 3)
    out.write(0, 1)
    single = sum(1 for x in own if x) == 1
    joined, n = 0, 0
    for s, extra, width in symbols:
        if not single:
            joined |= own_codes[s] << n
            n += own[s]
        joined |= extra << n
        n += width
    out.write(joined, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra value, extra bits) of a length or distance code from 1 on."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = (value - 1) >> (high - 1) & 1
    return 2 * high + second, (value - 1) & ((1 << (high - 1)) - 1), high - 1


def read_prefixed(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


# -- decoding ----------------------------------------------------------------------------------------------------------


def _groups(bits: Bits, count: int, cache: int) -> list[list[Code]]:
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    return [[Code(read_code(bits, n)) for n in sizes] for _ in range(count)]


def _pixels(bits: Bits, w: int, h: int, top: bool) -> list[int]:
    """An entropy-coded image as ARGB numbers, row by row; ``top``: it may have several groups of codes."""
    cache = 0
    if bits.read(1):
        cache = bits.read(4)
        if not 1 <= cache <= 11:
            raise ValueError("bad colour cache")
    which, block, across = None, 0, 0
    count = 1
    if top and bits.read(1):
        block = bits.read(3) + 2
        across = -(-w >> block)
        which = [p >> 8 & 0xFFFF for p in _pixels(bits, -(-w >> block), -(-h >> block), False)]
        count = max(which) + 1
    groups = _groups(bits, count, cache)
    stored = [0] * (1 << cache if cache else 0)
    shift, total, out = 32 - cache, w * h, []
    data, at, last = bits.number, bits.at, bits.size + 64
    lists = [[x for c in g for x in (c.list, (1 << c.width) - 1)] for g in groups]
    green, g_mask, red, r_mask, blue, b_mask, alpha, a_mask, far, f_mask = lists[0]
    number = int.from_bytes
    while (done := len(out)) < total:
        if which is not None:
            y, x = divmod(done, w)
            green, g_mask, red, r_mask, blue, b_mask, alpha, a_mask, far, f_mask = lists[which[(y >> block) * across + (x >> block)]]
        window = number(data[(k := at >> 3) : k + 9], "little") >> (at & 7)  # 65 bits: four codes of 15 at most
        s = green[window & g_mask]
        n = s & 15
        s >>= 4
        if s < 256:
            r = red[window >> n & r_mask]
            n += r & 15
            b = blue[window >> n & b_mask]
            n += b & 15
            a = alpha[window >> n & a_mask]
            at += n + (a & 15)
            p = a >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4
            out.append(p)
            if cache:
                stored[(_HASH * p & 0xFFFFFFFF) >> shift] = p
        elif s >= 280:
            out.append(p := stored[s - 280])  # it stands in its own slot, but for the 0 of an empty one
            at += n
            if not p:
                stored[0] = 0
        else:
            bits.at = at + n
            length = read_prefixed(bits, s - 256)
            f = far[bits.peek(15) & f_mask]
            bits.at += f & 15
            code = read_prefixed(bits, f >> 4)
            at = bits.at
            distance = code - 120
            if code <= 120:
                dx, dy = _NEAR[code - 1]
                distance = max(1, dx + dy * w)
            if distance > done or done + length > total:
                raise ValueError("a reference outside the image")
            if distance >= length:
                new = out[done - distance : done - distance + length]
            else:
                piece = out[-distance:]
                new = (piece * (length // distance + 1))[:length]
            out += new
            if cache:
                for p in new:
                    stored[(_HASH * p & 0xFFFFFFFF) >> shift] = p
    bits.at = at
    if at > last:
        raise ValueError("the file ends too early")
    return out


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _average(a: int, b: int) -> int:
    """Of each channel, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(x: int) -> int:
    return 0 if x < 0 else min(x, 255)


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction from the neighbours left, top, top right and top left."""
    if mode == 11:
        a, b, c = _channels(left), _channels(top), _channels(corner)
        return left if sum(abs(y - z) for y, z in zip(b, c)) < sum(abs(x - z) for x, z in zip(a, c)) else top
    if mode == 12:
        return _join([_clamp(x + y - z) for x, y, z in zip(*map(_channels, (left, top, corner)))])
    if mode == 13:
        pairs = zip(_channels(_average(left, top)), _channels(corner))
        return _join([_clamp(x + int((x - z) / 2)) for x, z in pairs])
    simple = (_BLACK, left, top, right, corner)
    if mode < 5:
        return simple[mode]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode in (6, 7, 8, 9):
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    return _BLACK


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    """Channel by channel; the ones between the channels take the borrows."""
    high = 0x00FF00FF + (a & 0xFF00FF00) - (b & 0xFF00FF00)
    low = 0xFF00FF00 + (a & 0x00FF00FF) - (b & 0x00FF00FF)
    return (high & 0xFF00FF00) | (low & 0x00FF00FF)


def _prediction(pixels: list[int], k: int, w: int, block: int, modes: list[int]) -> int:
    """For pixel k, from pixels before it."""
    y, x = divmod(k, w)
    if y == 0:
        return pixels[k - 1] if x else _BLACK
    if x == 0:
        return pixels[k - w]
    mode = modes[(y >> block) * -(-w >> block) + (x >> block)] >> 8 & 15
    return predicted(mode, pixels[k - 1], pixels[k - w], pixels[k - w + 1], pixels[k - w - 1])


def undo_predictor(residual: list[int], w: int, block: int, modes: list[int]) -> list[int]:
    out: list[int] = []
    for k, r in enumerate(residual):
        out.append(_add(r, _prediction(out, k, w, block, modes)))
    return out


def _cross(pixels: np.ndarray, w: int, block: int, elements: list[int], sign: int) -> np.ndarray:
    """Add (1) or take off (-1) the cross-colour terms, all pixels at once."""
    k = np.arange(len(pixels))
    e = np.array(elements, np.uint32)[(k // w >> block) * -(-w >> block) + (k % w >> block)]
    signed = lambda x: (x & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    term = lambda t, c: signed(t) * signed(c) >> 5
    red, green, blue = pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255
    new_red = red + sign * term(e, green) & 255
    new_blue = blue + sign * (term(e >> 8, green) + term(e >> 16, new_red if sign > 0 else red)) & 255
    return ((pixels & 0xFF00FF00) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)).astype(np.uint32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int64)
    red, blue = (pixels >> 16 & 255) + sign * green & 255, (pixels & 255) + sign * green & 255
    return ((pixels & 0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)).astype(np.uint32)


def _bundle(colours: int) -> int:
    """Two to this power palette indices share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, w: int, h: int, colours: list[int]) -> np.ndarray:
    share = _bundle(len(colours))
    depth = 8 >> share
    x = np.arange(w)
    packed = (pixels.reshape(h, -1) >> 8 & 255)[:, x >> share]
    index = packed >> ((x & ((1 << share) - 1)) * depth).astype(np.uint32) & ((1 << depth) - 1)
    table = np.zeros(256, np.uint32)  # an index past the palette is transparent black
    table[: len(colours)] = colours
    return table[index].reshape(-1)


def open_file(data: bytes) -> tuple[int, int, Bits]:
    """Width, height and the stream after them."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    head = struct.unpack("<I", data[21:25])[0]
    if head >> 29:
        raise ValueError("unknown version")
    return (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1, Bits(data, 25 * 8)


def _opened(data: bytes) -> tuple[int, int, int, list[tuple], Bits]:
    """Width, height, the width of the coded pixels, the transforms, and the stream at the pixels."""
    w, h, bits = open_file(data)
    transforms, now = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            transforms.append((kind, now, block, _pixels(bits, -(-now >> block), -(-h >> block), False)))
        elif kind == GREEN:
            transforms.append((kind, now, 0, []))
        else:
            colours = _pixels(bits, bits.read(8) + 1, 1, False)
            for k in range(1, len(colours)):
                colours[k] = _add(colours[k], colours[k - 1])
            transforms.append((kind, now, 0, colours))
            now = -(-now >> _bundle(len(colours)))
    return w, h, now, transforms, bits


def _undone(pixels: np.ndarray, h: int, transforms: list[tuple]) -> np.ndarray:
    for kind, width, block, extra in reversed(transforms):
        if kind == PREDICTOR:
            pixels = np.array(undo_predictor(pixels.tolist(), width, block, extra), np.uint32)
        elif kind == CROSS:
            pixels = _cross(pixels, width, block, extra, 1)
        elif kind == GREEN:
            pixels = _green(pixels, 1)
        else:
            pixels = undo_palette(pixels, width, h, extra)
    return pixels


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels (uint32, row by row)."""
    w, h, now, transforms, bits = _opened(data)
    return w, h, _undone(np.array(_pixels(bits, now, h, True), np.uint32), h, transforms)


# -- decoding many files -----------------------------------------------------------------------------------------------


def _words(lengths: np.ndarray, row: np.ndarray) -> np.ndarray:
    """As codes, for many codes at once: each symbol's length and ``row`` (ascending)."""
    words = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((lengths[used], row[used]))]
    share = 1 << (15 - lengths[used])
    before = np.cumsum(share) - share
    first = np.flatnonzero(np.diff(row[used], prepend=-1))
    before -= np.repeat(before[first], np.diff(first, append=len(used)))
    words[used] = _TURNED[before & 0x7FFF]
    return words


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As Code, for a code in each row: all lookups one behind the other, where each begins, and its mask."""
    rows, size = lengths.shape
    lengths = lengths.astype(np.int64)
    count = np.count_nonzero(lengths, axis=1)
    if (np.where(lengths > 0, 1 << (15 - lengths), 0).sum(1)[count > 1] != 1 << 15).any():
        raise ValueError("an incomplete prefix code")
    width = np.where(count > 1, lengths.max(1), 0)
    base = np.cumsum(1 << width) - (1 << width)
    table = np.zeros(int((1 << width).sum()), np.uint16)
    flat, row = lengths.reshape(-1), np.repeat(np.arange(rows), size)
    words = _words(flat, row)
    used = np.flatnonzero(flat)
    own, length, symbol = row[used], flat[used], used % size
    length = np.where(count[own] > 1, length, 0)
    times = 1 << (width[own] - length)
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    table[np.repeat(base[own] + words[used], times) + (nth << np.repeat(length, times))] = np.repeat(symbol << 4 | length, times)
    return table, base, (1 << width) - 1


#: By code-length symbol: least number of times, and extra bits.
_TIMES, _EXTRA = np.array([1] * 16 + [3, 3, 11]), np.array([0] * 16 + [2, 3, 7])


def _read_codes(windows: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As read_code, for a code in each of many streams: code lengths, and the places behind them. ``windows``: 64 bits from each byte."""
    lengths, at = np.zeros((len(at), int(size.max())), np.uint8), at.copy()
    window = windows[at >> 3] >> (at & 7)
    simple = np.flatnonzero(window & 1)
    w = window[simple] >> 1
    two, wide = w & 1, w >> 1 & 1
    first, second = w >> 2 & np.where(wide, 255, 1), w >> (2 + np.where(wide, 8, 1)) & 255
    if (np.maximum(first, second * two) >= size[simple]).any():
        raise ValueError("a symbol outside the alphabet")
    lengths[simple, first] = 1
    lengths[simple[two > 0], second[two > 0]] = 1
    at[simple] += 3 + np.where(wide, 8, 1) + 8 * two

    row = np.flatnonzero(~window & 1)
    if not len(row):
        return lengths, at
    n = 4 + (window[row] >> 1 & 15)
    place = at[row] + 5
    listed = (windows[place >> 3] >> (place & 7))[:, None] >> np.arange(19) * 3 & 7
    own = np.zeros((len(row), 19), np.int64)
    own[:, list(_LENGTH_ORDER)] = np.where(np.arange(19) < n[:, None], listed, 0)
    own[np.count_nonzero(own, axis=1) == 0, 0] = 1
    table, base, mask = _tables(own)
    place += 3 * n
    window = windows[place >> 3] >> (place & 7)
    bounded, wide = window & 1, 2 + 2 * (window >> 1 & 7)
    left = np.where(bounded, 2 + (window >> 4 & ((1 << wide) - 1)), size[row])
    place += np.where(bounded, 4 + wide, 1)
    state = np.stack([row, place, np.zeros(len(row), np.int64), np.full(len(row), 8), left, size[row], base, mask])
    found = []
    while state.shape[1]:
        row, place, to, before, left, most, base, mask = state
        window = windows[place >> 3] >> (place & 7)
        s = table[base + (window & mask)].astype(np.int64)
        n = s & 15
        s >>= 4
        extra = _EXTRA[s]
        times = _TIMES[s] + (window >> n & ((1 << extra) - 1))
        value = np.where(s < 16, s, np.where(s == 16, before, 0))
        found.append(np.stack([row, to, times, value]))
        state[3] = np.where(value > 0, value, before)
        place += n + extra
        to += times
        left -= 1
        if (to > most).any():
            raise ValueError("too many code lengths")
        live = (to < most) & (left > 0)
        if not live.all():
            at[row[~live]] = place[~live]
            state = state[:, live]
    row, to, times, value = np.concatenate(found, axis=1)
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    lengths[np.repeat(row, times), np.repeat(to, times) + nth] = np.repeat(value, times)
    return lengths, at


def _prefixed(window: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As read_prefixed, for many windows: values and the bits behind their prefixes."""
    extra = np.maximum((prefix - 2) >> 1, 0)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + (window & ((1 << extra) - 1))) + 1, extra


def _pixels_together(streams: list[tuple[Bits, int, int]]) -> list[np.ndarray]:
    """As _pixels with one group of codes: the next token of all streams (with width and height) is read at once. They stand
    at the colour cache's bit."""
    data = b"".join(b.number + bytes(16) for b, _, _ in streams) + bytes(8192)
    windows = np.ndarray((len(data) - 8,), "<i8", data, 0, (1,)).astype(np.int64)  # of which 57 bits are behind any bit of the first byte
    ahead = np.cumsum([0] + [len(b.number) + 16 for b, _, _ in streams[:-1]]) * 8
    at = ahead + [b.at for b, _, _ in streams]
    last = ahead + [b.size + 64 for b, _, _ in streams]
    width = np.array([w for _, w, _ in streams])
    total = np.array([w * h for _, w, h in streams])
    window = windows[at >> 3] >> (at & 7)
    cache = np.where(window & 1, window >> 1 & 15, 0)
    if ((window & 1 > 0) & ((cache < 1) | (cache > 11))).any():
        raise ValueError("a colour cache of no size")
    at += np.where(window & 1, 5, 1) + 1
    tables, bases, masks, ahead = [], [], [], 0
    for size in (280 + np.where(cache > 0, 1 << cache, 0), *(np.full(len(at), n) for n in (256, 256, 256, 40))):
        lengths, at = _read_codes(windows, at, size)
        if (at > last).any():
            raise ValueError("the file ends too early")
        lengths[np.count_nonzero(lengths, axis=1) == 0, 0] = 1
        table, base, mask = _tables(lengths)
        tables.append(table)
        bases.append(base + ahead)
        masks.append(mask)
        ahead += len(table)
    table = np.concatenate(tables)
    ends = np.cumsum(total)
    slots = 1 << cache
    out, stored = np.zeros(int(ends[-1]), np.int64), np.zeros(int(slots.sum()), np.int64)
    near = np.array([(0, 0), *_NEAR])
    state = np.stack([at, ends - total, ends, np.cumsum(slots) - slots, 32 - cache, *bases, *masks, width, last, ends - total])
    long = (np.stack(masks[:4]) + 1).prod(0).max() > 1 << 57
    step = 0
    while state.shape[1]:
        at, done, end, slot, shift, green, red, blue, alpha, far, g_mask, r_mask, b_mask, a_mask, f_mask, width, last, begin = state
        window = windows[at >> 3] >> (at & 7)
        s = table[green + (window & g_mask)].astype(np.int64)
        n = s & 15
        s >>= 4
        plain = s < 256
        r = table[red + (window >> n & r_mask)].astype(np.int64)
        m = n + (r & 15)
        b = table[blue + (window >> m & b_mask)].astype(np.int64)
        m += b & 15
        behind = windows[(at + m) >> 3] >> ((at + m) & 7) if long else window >> m
        a = table[alpha + (behind & a_mask)].astype(np.int64)
        m += a & 15
        p = np.where(plain, a >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4, 0)
        copy = np.flatnonzero(~plain & (s < 280))
        if plain.all():
            at += m
            out[done] = p
            stored[slot + ((_HASH * p & 0xFFFFFFFF) >> shift)] = p
            done += 1
        else:
            hit = np.flatnonzero(s >= 280)
            p[hit] = stored[slot[hit] + s[hit] - 280]
            if len(copy):
                k, c_width, c_at = copy, width[copy], at[copy] + n[copy]
                length, extra = _prefixed(window[k] >> n[k], s[k] - 256)
                f = table[far[k] + (window[k] >> (n[k] + extra) & f_mask[k])].astype(np.int64)
                c_at += extra + (f & 15)
                code, extra = _prefixed(windows[c_at >> 3] >> (c_at & 7), f >> 4)
                by = near[np.where(code <= 120, code, 0)]
                distance = np.where(code <= 120, np.maximum(1, by[:, 0] + by[:, 1] * c_width), code - 120)
                if ((distance > done[k] - begin[k]) | (done[k] + length > end[k])).any():
                    raise ValueError("a reference outside the image")
                nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                to = np.repeat(done[k], length)
                new = out[to - np.repeat(distance, length) + nth % np.repeat(distance, length)]
                out[to + nth] = new
                stored[np.repeat(slot[k], length) + ((_HASH * new & 0xFFFFFFFF) >> np.repeat(shift[k], length))] = new  # of one slot the last stays
                others = np.flatnonzero(plain | (s >= 280))
                one = p[others]
                out[done[others]] = one
                stored[slot[others] + ((_HASH * one & 0xFFFFFFFF) >> shift[others])] = one
                at += np.where(plain, m, n)
                at[k] = c_at + extra
                done += 1
                done[k] += length - 1
            else:
                at += np.where(plain, m, n)
                out[done] = p
                stored[slot + ((_HASH * p & 0xFFFFFFFF) >> shift)] = p
                done += 1
        live = done < end
        step += 1
        if step & 31 == 0 or not live.all():
            if (at > last).any():
                raise ValueError("the file ends too early")
            state = state[:, live]
    return np.split(out.astype(np.uint32), ends[:-1])


# -- encoding ----------------------------------------------------------------------------------------------------------


def _tokens(pixels: list[int], w: int, cache: int, matches: bool) -> list[tuple[int, ...]]:
    """Literals (colour,), cache hits (-1, slot) and copies (-2, length, distance code)."""
    near = {}
    for k in range(len(_NEAR) - 1, -1, -1):
        near[max(1, _NEAR[k][0] + _NEAR[k][1] * w)] = k + 1
    out, seen, stored, at = [], {}, {}, 0
    while at < len(pixels):
        length = 0
        key = tuple(pixels[at : at + 3])
        if matches and len(key) == 3 and (start := seen.get(key)) is not None:
            while length < 4096 and at + length < len(pixels) and pixels[start + length] == pixels[at + length]:
                length += 1
            out.append((-2, length, near.get(at - start, at - start + 120)))
        else:
            slot = (_HASH * pixels[at] & 0xFFFFFFFF) >> (32 - cache) if cache else 0
            out.append((-1, slot) if cache and stored.get(slot) == pixels[at] else (pixels[at],))
            length = 1
        for k in range(at, at + length):
            seen[tuple(pixels[k : k + 3])] = k
            if cache:
                stored[(_HASH * pixels[k] & 0xFFFFFFFF) >> (32 - cache)] = pixels[k]
        at += length
    return out


def _write_pixels(out: Writer, pixels: list[int], w: int, top: bool, cache: int = 0, matches: bool = False, group_block: int = 0) -> None:
    h = len(pixels) // w
    out.write(1 if cache else 0, 1)
    if cache:
        out.write(cache, 4)
    which, count = None, 1
    if top:
        out.write(1 if group_block else 0, 1)
        if group_block:  # two groups of codes in a chequered pattern
            out.write(group_block - 2, 3)
            across, down = -(-w >> group_block), -(-h >> group_block)
            which = [(x + y) & 1 for y in range(down) for x in range(across)]
            count = max(which) + 1
            _write_pixels(out, [g << 8 | _BLACK for g in which], across, False)
    tokens = _tokens(pixels, w, cache, matches)
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    weights = [[[0] * n for n in sizes] for _ in range(count)]
    at, plan = 0, []
    for t in tokens:
        g = 0
        if which is not None:
            y, x = divmod(at, w)
            g = which[(y >> group_block) * -(-w >> group_block) + (x >> group_block)]
        if t[0] == -2:
            a, b = prefix_of(t[1]), prefix_of(t[2])
            symbols = [(0, 256 + a[0], a[1], a[2]), (4, *b)]
            at += t[1]
        elif t[0] == -1:
            symbols = [(0, 280 + t[1], 0, 0)]
            at += 1
        else:
            alpha, red, green, blue = _channels(t[0])
            symbols = [(0, green, 0, 0), (1, red, 0, 0), (2, blue, 0, 0), (3, alpha, 0, 0)]
            at += 1
        for c, s, _, _ in symbols:
            weights[g][c][s] += 1
        plan.append((g, symbols))
    lengths = [[huffman(x, 15) for x in group] for group in weights]
    for group in lengths:
        for x in group:
            write_code(out, x)
    words = [[codes(x) for x in group] for group in lengths]
    single = [[sum(1 for n in x if n) <= 1 for x in group] for group in lengths]
    for g, symbols in plan:
        for c, s, extra, width in symbols:
            if not single[g][c]:
                out.write(words[g][c][s], lengths[g][c][s])
            out.write(extra, width)


def wrap(w: int, h: int, stream: bytes) -> bytes:
    body = b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14 | 1 << 28) + stream
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _transformed(out: Writer, w: int, h: int, pixels: np.ndarray, transforms: tuple, block: int, element: int | None) -> tuple[np.ndarray, int]:
    """Write the transforms; the pixels after them and their width."""
    now = w
    for kind in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        if kind in (PREDICTOR, CROSS):
            out.write(block - 2, 3)
            n = -(-now >> block) * -(-h >> block)
            extra = [(k * 5 % 14) << 8 | _BLACK for k in range(n)] if kind == PREDICTOR else [(k * 37 % 256) << 16 | (k * 11 % 256) << 8 | (200 + k) % 256 | _BLACK for k in range(n)]
            extra = extra if element is None else [element] * n
            _write_pixels(out, extra, -(-now >> block), False)
            if kind == PREDICTOR and element is not None:
                grid = pixels.astype("<u4").view(np.uint8).reshape(h, now, 4)
                pixels = (grid - _ahead(grid, np.zeros(1, np.int64), element >> 8 & 15)).view("<u4").reshape(-1).astype(np.uint32)
            elif kind == PREDICTOR:
                source = pixels.tolist()
                pixels = np.array([_subtract(p, _prediction(source, k, now, block, extra)) for k, p in enumerate(source)], np.uint32)
            else:
                pixels = _cross(pixels, now, block, extra, -1)
        elif kind == GREEN:
            pixels = _green(pixels, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            colours = colours.tolist()
            out.write(len(colours) - 1, 8)
            _write_pixels(out, [colours[0], *(_subtract(b, a) for a, b in zip(colours, colours[1:]))], len(colours), False)
            share = _bundle(len(colours))
            wide = -(-now >> share) << share
            grid = np.zeros((h, wide), np.uint32)
            grid[:, :now] = index.reshape(h, now)
            shifts = (np.arange(1 << share) * (8 >> share)).astype(np.uint32)
            packed = (grid.reshape(h, -1, 1 << share) << shifts).sum(2).astype(np.uint32)
            now = packed.shape[1]
            pixels = (packed << 8 | np.uint32(_BLACK)).reshape(-1).astype(np.uint32)
    out.write(0, 1)
    return pixels, now


def encode(w: int, h: int, pixels: np.ndarray, transforms: tuple = (), cache: int = 0, matches: bool = True, block: int = 3, group_block: int = 0, element: int | None = None) -> bytes:
    """A file of the ARGB pixels. transforms: kinds in their order in the file; a palette needs 256 colours at most.
    element: the predictor's or cross-colour transform's for all blocks, with which the pixels are packed as in payloads."""
    out = Writer()
    pixels, now = _transformed(out, w, h, np.asarray(pixels, np.uint32).reshape(-1), transforms, block, element)
    if element is not None:
        return wrap(w, h, _packed([(out, pixels, now)])[0])
    _write_pixels(out, pixels.tolist(), now, True, cache, matches, group_block)
    return wrap(w, h, out.bytes())


# -- payloads in batches -----------------------------------------------------------------------------------------------


#: Bits of the colour cache of payloads, and the longest code word.
CACHE, LONGEST = 8, 11
#: Payload bytes and files that are written together at most; a longer payload is written alone.
TOGETHER, FILES = 1 << 20, 1024
#: Farther back than this no distance code reaches.
FARTHEST = (1 << 20) - 120
#: Where the symbols of green, red, blue, alpha and distance stand among all symbols of a file.
_FIRST = np.array([0, 280 + (1 << CACHE), 536 + (1 << CACHE), 792 + (1 << CACHE), 1048 + (1 << CACHE), 1088 + (1 << CACHE)])
_ALPHABET = np.repeat(np.arange(5), np.diff(_FIRST))


@lru_cache(maxsize=64)
def _near_codes(w: int) -> np.ndarray:
    """The lowest code of each distance up to the farthest near one."""
    found = {max(1, _NEAR[k][0] + _NEAR[k][1] * w): k + 1 for k in range(len(_NEAR) - 1, -1, -1)}
    table = np.arange(max(found) + 1) + 120
    table[list(found)] = list(found.values())
    return table


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As prefix_of, for all values at once."""
    v = values - 1
    more = np.maximum(np.frexp(v.astype(np.float64))[1] - 2, 0)  # bits behind the two highest ones
    return np.where(v < 4, v, 2 * (more + 1) + (v >> more & 1)), v & ((1 << more) - 1), more


def _merged(weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Depths of Huffman's trees over the ascending weights of each row, of which ``sizes`` (descending, 2 at least) count: all
    rows make their next node together, from a queue of leaves and one of nodes."""
    rows, most = weights.shape
    endless = np.iinfo(np.int64).max >> 2
    leaves, nodes = np.full((rows, most + 1), endless), np.full((rows, most), endless)
    leaves[:, :most] = np.where(np.arange(most) < sizes[:, None], weights, endless)
    over = np.zeros((rows, 2 * most + 1), np.int64)  # the node above each leaf, and from most + 1 on above each node
    at = np.zeros((2, rows), np.int64)
    every = np.arange(rows)
    active = np.searchsorted(-sizes, -np.arange(1, most + 1))  # rows of more than 1, 2 .. symbols
    for step in range(most - 1):
        n = int(active[step])
        each, i, j = every[:n], at[0, :n], at[1, :n]
        total = 0
        for _ in range(2):
            leaf, node = leaves[each, i], nodes[each, j]
            first = leaf <= node
            over[each, np.where(first, i, j + most + 1)] = step
            total = total + np.where(first, leaf, node)
            i += first
            j += ~first
        nodes[:n, step] = total
    depth = np.zeros((rows, most), np.int64)
    for step in range(most - 3, -1, -1):
        n = int(active[step + 1])
        depth[:n, step] = depth[every[:n], over[:n, most + 1 + step]] + 1
    return np.take_along_axis(depth, over[:, :most], 1) + 1


def _fitted(weights: np.ndarray, row: np.ndarray, limit: int) -> np.ndarray:
    """As huffman, for many codes at once: ``weights`` of all symbols, each one's ``row`` (ascending). Lengths of the symbols."""
    lengths = np.zeros(len(weights), np.int64)
    used = np.flatnonzero(weights > 0)
    if not len(used):
        return lengths
    used = used[np.lexsort((weights[used], row[used]))]
    starts = np.flatnonzero(np.diff(row[used], prepend=-1))
    sizes = np.diff(starts, append=len(used))
    lengths[used[starts[sizes == 1]]] = 1
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    least = np.ones(len(order), np.int64)
    while len(order):
        size = sizes[order]
        column = np.arange(size[0])
        inside = column < size[:, None]
        place = used[np.where(inside, starts[order][:, None] + column, 0)]
        own = np.where(inside, weights[place], 0)
        depth = _merged(np.maximum(own, least[:, None]), size)
        lengths[place[inside]] = depth[inside]
        over = np.where(inside, depth, 0).max(1) > limit
        order, least = order[over], np.maximum(np.maximum(least + 1, 2 * least), own.sum(1) >> limit)[over]
    return lengths


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their keys (of 30 bits where there are over 2^22 of them, else of 42), then of themselves, and which
    have the key of the one before."""
    low = 22 if len(key) <= 1 << 22 else 34
    found = np.sort(key.astype(np.uint64) << np.uint64(low) | np.arange(len(key), dtype=np.uint64))
    key = found >> np.uint64(low)
    return (found & np.uint64((1 << low) - 1)).astype(np.int64), np.concatenate([[False], key[1:] == key[:-1]])


def _copies(pixels: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references, each to the last place in its file with the same three pixels."""
    n = len(pixels)
    back = np.zeros(n + 1, np.int64)  # distance of each place's three pixels to the same ones before, or 0
    if n > 3:
        p = pixels.astype(np.uint64)
        mixed = p[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ p[2:] * np.uint64(0x165667B19E3779F9)
        order, same = _ordered((mixed >> np.uint64(34)).astype(np.int64) | file[:-2] << 30)
        k, start = order[same], order[np.flatnonzero(same) - 1]
        good = (file[k] == file[k + 2]) & (file[start] == file[start + 2]) & (k - start <= FARTHEST)
        for x in range(3):
            good &= pixels[k + x] == pixels[start + x]
        back[k[good]] = (k - start)[good]
    some = np.flatnonzero(back)
    ends = np.flatnonzero(back[:-1] != back[1:])  # the last place of each run of one distance
    lengths = np.minimum(ends[np.searchsorted(ends, some)] - some + 3, 4096)
    taken, at = [], 0
    for x, (k, length) in enumerate(zip(some.tolist(), lengths.tolist())):
        if k >= at:
            taken.append(x)
            at = k + length
    taken = np.array(taken, np.int64)
    return some[taken], lengths[taken], back[some[taken]]


def _length_codes(lengths: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As write_code, for many codes at once: row, word and bits of all that is written, in order. No row is left out."""
    used = np.bincount(row, lengths > 0, rows).astype(np.int64)
    first = np.searchsorted(row, np.arange(rows))
    held = np.flatnonzero(lengths)
    symbol = held - first[row[held]]
    plain = (used <= 2) & (np.bincount(row[held], symbol > 255, rows) == 0)
    words, sizes = 1 | 4 | (np.maximum(used, 1) - 1) << 1, np.where(used == 2, 19, 11)
    some = plain[row[held]]
    nth = np.arange(len(held)) - np.searchsorted(row[held], row[held])
    np.add.at(words, row[held][some], symbol[some] << (3 + 8 * nth[some]))
    simple = np.flatnonzero(plain)

    full = np.flatnonzero(~plain[row])
    value, own = lengths[full], row[full]
    start = np.flatnonzero((np.diff(value, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
    n, value, own = np.diff(start, append=len(full)), value[start], own[start]
    zero = value == 0
    whole, rest = np.where(zero, n // 138, 2 * (n // 7)), np.where(zero, n % 138, n % 7)
    times = whole + np.where(zero, np.where(rest >= 3, 1, rest), np.where(rest >= 4, 2, rest))
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    value, own, zero, whole, rest = (np.repeat(x, times) for x in (value, own, zero, whole, rest))
    again = ~zero & np.where(nth < whole, nth & 1 == 1, (rest >= 4) & (nth > whole))
    rest = np.where(nth < whole, np.where(zero, 138, 7), rest)
    far, few = zero & (rest >= 11), zero & (rest >= 3) & (rest < 11)
    symbol = np.where(again, 16, np.where(far, 18, np.where(few, 17, value)))
    extra = np.where(again, rest - 4, np.where(far, rest - 11, np.where(few, rest - 3, 0)))
    width = np.where(again, 2, np.where(far, 7, np.where(few, 3, 0)))
    wide = np.repeat(np.arange(rows), 19)
    fitted = _fitted(np.bincount(own * 19 + symbol, minlength=19 * rows), wide, 7)
    coded = _words(fitted, wide)
    bits = np.where(np.count_nonzero(fitted.reshape(rows, 19), axis=1)[own] == 1, 0, fitted[own * 19 + symbol])
    normal = np.flatnonzero(~plain)
    listed = fitted.reshape(rows, 19)[normal][:, list(_LENGTH_ORDER)]
    last = np.maximum(19 - (listed[:, ::-1] > 0).argmax(1), 4)
    head = np.concatenate([(last - 4)[:, None] << 1, listed, np.zeros((len(normal), 1), np.int64)], axis=1)
    head_bits = np.concatenate([np.full((len(normal), 1), 5), np.where(np.arange(19) < last[:, None], 3, 0), np.ones((len(normal), 1), np.int64)], axis=1)
    parts = ((simple, words[simple], sizes[simple]), (np.repeat(normal, 21), head.reshape(-1), head_bits.reshape(-1)), (own, np.where(bits > 0, coded[own * 19 + symbol], 0) | extra << bits, bits + width))
    rows_of, words, sizes = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(rows_of, kind="stable")
    return rows_of[order], words[order], sizes[order]


def _packed(images: list[tuple[Writer, np.ndarray, int]]) -> list[bytes]:
    """For each image (what is written ahead of its pixels, the pixels, its width) the stream: back-references, colour cache
    where a pixel in 32 is in it, codes fitted to the file. As _write_pixels, but all tokens of all images at once."""
    count = len(images)
    size = np.array([len(p) for _, p, _ in images])
    pixels = np.concatenate([p for _, p, _ in images])
    file = np.repeat(np.arange(count), size)
    n = len(pixels)
    slot = (pixels.astype(np.uint64) * np.uint64(_HASH) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - CACHE)
    order, same = _ordered(file << CACHE | slot)
    hit = np.zeros(n, bool)
    hit[order[1:]] = same[1:] & (pixels[order[1:]] == pixels[order[:-1]])
    cached = 32 * np.bincount(file, hit, count).astype(np.int64) >= size
    hit &= cached[file]
    place, length, distance = _copies(pixels, file)
    far = distance + 120
    width = np.array([w for _, _, w in images])[file[place]]
    for w in np.unique(width).tolist():
        table = _near_codes(w)
        some = np.flatnonzero((width == w) & (distance < len(table)))
        far[some] = table[distance[some]]
    ends = np.zeros(n + 1, np.int64)
    ends[place + 1] += 1
    ends[place + length] -= 1
    index = np.flatnonzero(np.cumsum(ends[:-1]) == 0)
    own = file[index]
    symbols = pixels[index].astype("<u4").view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]].astype(np.int64) + _FIRST[:4]
    literal = ~hit[index]
    symbols[~literal, 0] = 280 + slot[index][~literal]
    at = np.searchsorted(index, place)
    long, long_extra, long_bits = _prefixes(length)
    away, away_extra, away_bits = _prefixes(far)
    literal[at] = False
    symbols[at, 0] = 256 + long
    symbols += (own * _FIRST[5])[:, None]
    away += own[at] * _FIRST[5] + _FIRST[4]
    weights = np.bincount(np.concatenate([symbols[:, 0], symbols[literal, 1:].reshape(-1), away]), minlength=count * int(_FIRST[5]))
    row = (np.arange(count)[:, None] * 5 + _ALPHABET).reshape(-1)
    fitted = _fitted(weights, row, LONGEST)
    words = _words(fitted, row)
    there = np.ones((count, _FIRST[5]), bool)
    there[~cached, 280 : 280 + (1 << CACHE)] = False
    there = there.reshape(-1)
    code_row, code_word, code_bits = _length_codes(fitted[there], row[there], 5 * count)
    single = np.bincount(row, weights > 0, 5 * count) <= 1
    bits = np.where(single[row], 0, fitted)

    token_words, token_bits = np.zeros(symbols.shape, np.int64), np.zeros(symbols.shape, np.int64)
    token_words[:, 0], token_bits[:, 0] = words[symbols[:, 0]], bits[symbols[:, 0]]
    token_words[literal, 1:], token_bits[literal, 1:] = words[symbols[literal, 1:]], bits[symbols[literal, 1:]]
    token_words[at, 1:], token_bits[at, 1:] = np.stack([long_extra, words[away], away_extra], 1), np.stack([long_bits, bits[away], away_bits], 1)

    heads = []
    for (out, _, _), cache in zip(images, cached.tolist()):
        out.write(1 | CACHE << 1 if cache else 0, 6 if cache else 2)  # the cache, and one group of codes
        heads.append((out.bits(), np.frombuffer(out.bytes() + b"\0", np.uint8)[: (out.bits() + 7) // 8].astype(np.int64)))
    head_file = np.repeat(np.arange(count), [len(x) for _, x in heads])
    head_bits = np.concatenate([np.minimum(8, b - 8 * np.arange(len(x))) for b, x in heads])
    parts = ((head_file, np.concatenate([x for _, x in heads]), head_bits), (code_row // 5, code_word, code_bits), (np.repeat(own, 4), token_words.reshape(-1), token_bits.reshape(-1)))
    totals = np.stack([np.bincount(f, b, count).astype(np.int64) for f, _, b in parts])
    whole = totals.sum(0)
    begin = np.concatenate([[0], np.cumsum((whole + 31) >> 5)])  # each file begins at a number of 32 bits
    low = np.zeros(begin[-1] + 1, np.int64)
    start = begin[:-1] * 32
    for (f, word, bit), total in zip(parts, totals):
        local = np.cumsum(bit) - bit + (start - (np.cumsum(total) - total))[f]
        # no word has over 20 bits, so the sums are exact
        sums = np.bincount(local >> 5, (word << (local & 31)).astype(np.float64), len(low)).astype(np.int64)
        low += sums & 0xFFFFFFFF
        low[1:] += sums[:-1] >> 32
        start = start + total
    stream = low.astype("<u4").tobytes()
    return [stream[4 * b : 4 * b + (t + 7) // 8] for b, t in zip(begin.tolist(), whole.tolist())]


def payload(text: str) -> tuple[bytes, int]:
    """The padded bytes and the number of bytes before the padding."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(64 - len(raw) % 64 if raw else 64) if len(raw) % 64 or not raw else raw, len(raw)


def shape(size: int) -> tuple[int, int]:
    """Width and height of an image for ``size`` payload bytes: 16 pixels wide, or more where that is too high."""
    n = size // 4
    w = 16 * max(1, -(-n // (16 * 16384)))
    return w, -(-n // w)


def _ahead(grid: np.ndarray, tops: np.ndarray, mode: int) -> np.ndarray:
    """The predictions for rows of pixels (of four bytes), of which ``tops`` are the first ones of images; for the modes left (1),
    above (2) and above to the left (4)."""
    ahead = np.empty_like(grid)
    above = np.roll(grid, 1, axis=0)
    ahead[:, 0] = above[:, 0]
    ahead[:, 1:] = grid[:, :-1] if mode == 1 else above[:, 1:] if mode == 2 else above[:, :-1]
    ahead[tops, 1:] = grid[tops, :-1]
    ahead[tops, 0] = (0, 0, 0, 255)
    return ahead


def _transforms(images: list[np.ndarray], w: int) -> list[tuple[tuple[int, ...], int]]:
    """The transform of each file and its element: a palette for few colours, else that of the least entropy of the channels among
    none, subtract-green, cross-colour at half of green either way (where subtract-green doesn't cost a tenth more), and the pixel
    to the left, above and above to the left as predictors. A transform has to save its own bits."""
    count, size = len(images), np.array([len(x) for x in images])
    pixels = np.concatenate(images)
    file = np.repeat(np.arange(count), size)
    raw = pixels.astype("<u4").view(np.uint8).reshape(-1, 4)
    grid = raw.reshape(-1, w, 4)
    tops = (np.cumsum(size) - size) // w
    colours = np.sort(file << 32 | pixels.astype(np.int64))
    colours = np.bincount(colours[np.diff(colours, prepend=-1) != 0] >> 32, minlength=count)

    def cost(x: np.ndarray, some: np.ndarray = file) -> np.ndarray:
        c = np.bincount((x.reshape(-1, 4) + (some[:, None] * 1024 + np.arange(4) * 256)).reshape(-1), minlength=1024 * count)
        held = np.flatnonzero(c)
        return 4 * size * np.log2(size) - np.bincount(held >> 10, c[held] * np.log2(c[held]), count)

    found = np.full((8, count), np.inf)
    found[0], found[1] = cost(raw) - 64, cost(_green(pixels, -1).astype("<u4").view(np.uint8))
    kinds: list[tuple[tuple[int, ...], int]] = [((), 0), ((GREEN,), 0)]
    crossed = found[1] < 1.1 * found[0]
    some = np.flatnonzero(crossed[file])
    for k, t in enumerate((16, 240)):
        kinds.append(((CROSS,), t << 8 | t | _BLACK))
        if len(some):
            part = pixels[some]
            found[2 + k, crossed] = cost(_cross(part, w, 9, [kinds[-1][1]] * (-(-w >> 9) * -(-(len(part) // w) >> 9)), -1).astype("<u4").view(np.uint8), file[some])[crossed]
    for k, mode in enumerate((1, 2, 4)):
        kinds.append(((PREDICTOR,), mode << 8 | _BLACK))
        found[4 + k] = cost(grid - _ahead(grid, tops, mode))
    few = colours <= np.minimum(256, np.maximum(16, size // 8))
    return [((PALETTE,), 0) if f else kinds[k] for f, k in zip(few.tolist(), found.argmin(0).tolist())]


def _write_together(payloads: list[bytes], w: int) -> list[bytes]:
    """The files of payloads, all of one width."""
    images = [np.frombuffer(raw.ljust(-(-len(raw) // (4 * w)) * 4 * w, b"\0"), "<u4").astype(np.uint32) for raw in payloads]
    ready = []
    for pixels, (kinds, element) in zip(images, _transforms(images, w)):
        out = Writer()
        ready.append((out, *_transformed(out, w, len(pixels) // w, pixels, kinds, 9, element)))
    return [wrap(w, len(pixels) // w, stream) for pixels, stream in zip(images, _packed(ready))]


def write_batch(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload; equal ones are written once."""
    files: dict[bytes, bytes] = {}
    together: list[bytes] = []
    room = 0
    for raw in sorted(dict.fromkeys(payloads), key=len):
        if together and (len(raw) > room or len(together) == FILES or shape(len(raw))[0] != shape(len(together[0]))[0]):
            files.update(zip(together, _write_together(together, shape(len(together[0]))[0])))
            together = []
        if not together:
            room = TOGETHER
        room -= len(raw)
        together.append(raw)
    if together:
        files.update(zip(together, _write_together(together, shape(len(together[0]))[0])))
    return [files[raw] for raw in payloads]


#: A step of many streams takes about as long as so many tokens of one alone; so many files are read together at most.
STEP, STREAMS = 24, 2048


def decode_batch(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file, as by decode(). Streams that outlast most others, and those with several groups of codes, are
    read by themselves, the rest together."""
    opened = [_opened(f) for f in files]
    found: list = [None] * len(files)
    grouped = lambda bits: bits.peek(6) >> (5 if bits.peek(1) else 1) & 1
    some = sorted((k for k in range(len(files)) if not grouped(opened[k][4])), key=lambda k: -opened[k][1] * opened[k][2])
    for first in range(0, len(some), STREAMS):
        part = some[first : first + STREAMS]
        size = np.array([opened[k][1] * opened[k][2] for k in part] + [0])
        part = part[int((np.cumsum(size) - size + STEP * size).argmin()) :]
        if part:
            for k, pixels in zip(part, _pixels_together([(opened[k][4], opened[k][2], opened[k][1]) for k in part])):
                found[k] = pixels
    for k, (_, h, now, transforms, bits) in enumerate(opened):
        if found[k] is None:
            found[k] = np.array(_pixels(bits, now, h, True), np.uint32)
        found[k] = _undone(found[k], h, transforms)
    return found


def read_batch(files: list[bytes]) -> list[bytes]:
    """The pixels of each file as bytes; equal files are read once."""
    once = list(dict.fromkeys(files))
    found = {f: pixels.astype("<u4").tobytes() for f, pixels in zip(once, decode_batch(once))}
    return [found[f] for f in files]


def feature(pixels: bytes, w: int, h: int) -> str:
    """Size, mean and deviation of the samples, and the share of zeros."""
    x = np.frombuffer(pixels, np.uint8)
    return f"{w}x{h} mean={x.mean():.4f} dev={x.std():.4f} zeros={1 - np.count_nonzero(x) / len(x):.4f}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, with_file: bool = False) -> DataFrame:
    """The payload of every row stored as WebP, read back and measured; ``with_file`` adds the file (``media``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, 8 << 20)):
            given = [payload(x) for x in batch.column(1).to_pylist()]
            files = write_batch([p for p, _ in given])
            rows = []
            for doc_id, (padded, n), file, back in zip(batch.column(0).to_pylist(), given, files, read_batch(files)):
                w, h = shape(len(padded))
                stored = back[: len(padded)]
                rows.append((
                    doc_id, n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(stored, w, h), file,
                ))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = [*(f.split()[0] for f in SCHEMA.split(", ")), "media"]
            keep = 9 if with_file else 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:keep], kinds)], names=names[:keep])

    return texts(docs).mapInArrow(run, SCHEMA + (", media binary" if with_file else ""))
