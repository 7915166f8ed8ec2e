"""Lossless WebP (VP8L): media columns stored as image files, read back to pixel arrays.

The decoder follows the public bitstream specification: prefix codes, back-references, colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.  The encoder chooses for
each image: few colours become a palette with bundled indices; otherwise pixels that repeat 17 or more
earlier ones become back-references, and the rest literals.  Red, green and blue share one prefix code (the
lengths of references take the codes of bytes that the image does not hold); such streams are decoded several symbols at
a time from a table, up to the next reference.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import written

ROW_BYTES = 192
WIDTH = ROW_BYTES // 3
MAX_HEIGHT = 16_384

# Fixed values of the format: the order of code-length code lengths, and the near pixels that
# short distance codes name, as (columns back, rows up).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
#: Bytes that get codes of 5 and of 9 bits; all others get 10, which makes the code complete.
FIVE_BITS = b" etaonrishdlucmgpbfvy.,\xc3"
NINE_BITS = b"wkzqjx\nTEAOISNRDHLCUM\xa9\xa8-"


class Bits:
    """Reads a byte string bit by bit, lowest bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the WebP stream is too short")
        return value


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of these lengths, first bit lowest."""
    codes, code = np.zeros(len(lengths), np.int64), 0
    for n in range(1, 16):
        for s in np.flatnonzero(lengths == n).tolist():
            codes[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
        code <<= 1
    return codes


def _span(data: bytes, at: int, n: int) -> int:
    return (int.from_bytes(data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


#: Of each alphabet size: the bits of the last code description, their number, and the code.
_LAST: dict[int, tuple] = {}


class PrefixCode:
    """Table of the next symbol and its length, by the bits ahead."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else (0 if not len(used) else None)
        if self.only is None:
            self.bits = int(lengths.max())
            if (2.0 ** -lengths[used].astype(float)).sum() != 1.0:
                raise ValueError("a prefix code is not complete")
            self.symbol, self.length = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
            codes = reversed_codes(lengths)
            for s in used.tolist():
                self.symbol[codes[s] :: 1 << lengths[s]] = s
                self.length[codes[s] :: 1 << lengths[s]] = lengths[s]
            self.pairs = list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.pairs[bits.peek(self.bits)]
        bits.at += n
        return symbol

    @staticmethod
    def read(bits: Bits, size: int) -> PrefixCode:
        """The code described next; a description like the last one of this size is known by its bits."""
        start, known = bits.at, _LAST.get(size)
        if known and _span(bits.data, start, known[1]) == known[0]:
            bits.at += known[1]
            return known[2]
        code = PrefixCode._described(bits, size)
        _LAST[size] = (_span(bits.data, start, bits.at - start), bits.at - start, code)
        return code

    @staticmethod
    def _described(bits: Bits, size: int) -> PrefixCode:
        lengths = np.zeros(size, np.int64)
        if bits.read(1):
            two = bits.read(1)
            lengths[bits.read(8 if bits.read(1) else 1)] = 1
            if two:
                lengths[bits.read(8)] = 1
            return _code(lengths.astype(np.uint8).tobytes())
        own = np.zeros(19, np.int64)
        for k in LENGTH_ORDER[: 4 + bits.read(4)]:
            own[k] = bits.read(3)
        code = _code(own.astype(np.uint8).tobytes())
        budget = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
        at, before = 0, 8
        lengths = [0] * (size + 138)
        while at < size and budget:
            budget -= 1
            s = code.next(bits)
            if s < 16:
                lengths[at] = s
                at += 1
                before = s or before
            elif s == 16:
                n = 3 + bits.read(2)
                lengths[at : at + n] = [before] * n
                at += n
            else:
                at += 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        return _code(bytes(lengths[:size]))


@functools.lru_cache(maxsize=64)
def _code(lengths: bytes) -> PrefixCode:
    return PrefixCode(np.frombuffer(lengths, np.uint8).astype(np.int64))


def _prefixed(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


@functools.lru_cache(maxsize=8)
def _many(lengths: bytes, marks: frozenset) -> list[tuple[bytes, int, int]]:
    """For each 16 bits ahead: the whole symbols there up to a mark, their bits, and the bits of the mark that follows or 0."""
    code = _code(lengths)
    one = code.pairs
    mask, out = (1 << code.bits) - 1, []
    for window in range(1 << 16):
        at, found, mark = 0, [], 0
        while True:
            s, n = one[(window >> at) & mask]
            if at + n > 16:
                break
            if s in marks:
                mark = n
                break
            found.append(s)
            at += n
        out.append((bytes(found), at, mark))
    return out


@functools.lru_cache(maxsize=64)
def _shared(green: bytes, red: bytes) -> dict[int, int] | None:
    """Symbols of red whose code is that of a length in green, with that length's symbol; None unless all other codes are the same."""
    table = [np.frombuffer(x, np.uint8).astype(np.int64) for x in (green, red)]
    codes = [{(int(n[s]), int(c[s])): s for s in np.flatnonzero(n).tolist()} for n in table for c in [reversed_codes(n)]]
    if len(np.flatnonzero(table[1])) < 2 or codes[0].keys() != codes[1].keys():
        return None
    marks = {s: codes[0][k] for k, s in codes[1].items() if codes[0][k] != s}
    return marks if all(s >= 256 for s in marks.values()) else None


def _run(bits: Bits, red: PrefixCode, marks: dict[int, int], far: PrefixCode, total: int, width: int) -> np.ndarray:
    """``total`` pixels (green, red, blue) of one code for all three; a mark in green's place is a back-reference."""
    raw = np.frombuffer(bits.data[bits.at >> 3 :] + b"\0\0\0\0", np.uint8).astype(np.int32)
    ahead = (raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16).tolist()
    table, base, at, out, last = _many(red.lengths.astype(np.uint8).tobytes(), frozenset(marks)), bits.at & ~7, bits.at & 7, bytearray(), 3 * total
    limit = 8 * len(ahead)
    while len(out) < last:
        if at >= limit:
            raise ValueError("the WebP stream is too short")
        symbols, n, mark = table[(ahead[at >> 3] >> (at & 7)) & 0xFFFF]
        out += symbols
        at += n
        if mark and len(out) < last:
            bits.at = base + at
            s = red.next(bits)
            if len(out) % 3:
                out.append(s)
            else:
                many, d = _prefixed(bits, marks[s] - 256), _distance(bits, far, width)
                start = len(out) - 3 * d
                if start < 0:
                    raise ValueError("a back-reference points before the image")
                out += out[start : start + 3 * many] if d >= many else (bytes(out[start:]) * (many // d + 1))[: 3 * many]
            at = bits.at - base
    bits.at = base + at
    return np.frombuffer(bytes(out[:last]), np.uint8)


def _distance(bits: Bits, far: PrefixCode, width: int) -> int:
    d = _prefixed(bits, far.next(bits))
    if d > 120:
        return d - 120
    dx, dy = NEAR[d - 1]
    return max(1, dx + dy * width)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as flat ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, group_of, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width // (1 << block))
        group_of = ((_image(bits, across, -(-height // (1 << block)), False) >> 8) & 0xFFFF).astype(np.int64)
        meta = int(group_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[PrefixCode.read(bits, n) for n in sizes] for _ in range(meta)]
    total = width * height
    green, red, blue, alpha, far = groups[0]
    same = green.only is None and red.only is None and blue.only is None
    # Nothing follows the main image, so reading whole windows of it may pass its end.
    if main and meta == 1 and not cache_bits and alpha.only is not None and same and (red.lengths == blue.lengths).all() and red.lengths.max() <= 16:
        marks = _shared(green.lengths.astype(np.uint8).tobytes(), red.lengths.astype(np.uint8).tobytes())
        if marks is not None:
            g, r, b = _run(bits, red, marks, far, total, width).reshape(-1, 3).astype(np.uint32).T
            return np.uint32(alpha.only << 24) | r << 16 | g << 8 | b
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    cached = 0  # pixels before this one are in the cache

    def refresh() -> None:
        nonlocal cached
        for p in out[cached:]:
            cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        cached = len(out)

    while len(out) < total:
        if group_of is not None:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, far = groups[group_of[(y >> block) * across + (x >> block)]]
        s = green.next(bits)
        if s < 256:
            r, b, a = red.next(bits), blue.next(bits), alpha.next(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _prefixed(bits, s - 256)
            d = _distance(bits, far, width)
            if d > len(out):
                raise ValueError("a back-reference points before the image")
            for _ in range(min(n, total - len(out))):
                out.append(out[-d])
        else:
            refresh()
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(values) -> int:
    a, r, g, b = (min(255, max(0, v)) for v in values)
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictor's guess from the left, top, top-right and top-left pixels."""
    if mode == 11:
        far_left = sum(abs(t - c) for t, c in zip(_channels(top), _channels(corner), strict=True))
        far_top = sum(abs(v - c) for v, c in zip(_channels(left), _channels(corner), strict=True))
        return left if far_left < far_top else top
    if mode == 12:
        return _joined(v + t - c for v, t, c in zip(_channels(left), _channels(top), _channels(corner), strict=True))
    if mode == 13:
        both = _average(left, top)
        return _joined(m + int((m - c) / 2) for m, c in zip(_channels(both), _channels(corner), strict=True))
    return (
        lambda: 0xFF000000, lambda: left, lambda: top, lambda: right, lambda: corner,
        lambda: _average(_average(left, right), top), lambda: _average(left, corner), lambda: _average(left, top),
        lambda: _average(corner, top), lambda: _average(top, right),
        lambda: _average(_average(left, corner), _average(top, right)),
    )[mode]() if mode < 11 else 0xFF000000


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def guesses(mode_of, width: int, height: int, pixels: list[int], at: int) -> int:
    """The prediction for pixel ``at`` from the pixels before it."""
    y, x = divmod(at, width)
    if at == 0:
        return 0xFF000000
    if y == 0:
        return pixels[at - 1]
    if x == 0:
        return pixels[at - width]
    return predicted(mode_of(x, y), pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def _undo_predictor(image: np.ndarray, modes: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    across = -(-width // (1 << bits))
    table = ((modes >> 8) & 15).tolist()
    out = image.tolist()
    for k in range(len(out)):
        out[k] = _add(out[k], guesses(lambda x, y: table[(y >> bits) * across + (x >> bits)], width, height, out, k))
    return np.array(out, np.uint32)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int32)


def _undo_cross(image: np.ndarray, by: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    across = -(-width // (1 << bits))
    y, x = np.divmod(np.arange(width * height), width)
    t = by[(y >> bits) * across + (x >> bits)]
    green = _signed(image >> 8 & 255)
    red = (image >> 16 & 255).astype(np.int32) + (_signed(t & 255) * green >> 5) & 255
    blue = (image & 255).astype(np.int32) + (_signed(t >> 8 & 255) * green >> 5)
    blue = blue + (_signed(t >> 16 & 255) * _signed(red) >> 5) & 255
    return image & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _undo_green(image: np.ndarray) -> np.ndarray:
    green = image >> 8 & 255
    return image & np.uint32(0xFF00FF00) | ((image >> 16) + green & 255) << 16 | (image + green & 255)


def _undo_palette(image: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    shift = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    index = (image >> 8 & 255).reshape(height, -1)
    if shift:
        each = 8 >> shift
        index = np.stack([index >> each * k & (1 << each) - 1 for k in range(1 << shift)], axis=2).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index].ravel()


def decode_vp8l(data: bytes) -> np.ndarray:
    """Height x width ARGB pixels of a VP8L payload."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP payload")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            size = bits.read(3) + 2
            part = _image(bits, -(-coded // (1 << size)), -(-height // (1 << size)), False)
            steps.append((kind, part, size, coded))
        elif kind == 2:
            steps.append((kind, None, 0, coded))
        else:
            size = bits.read(8) + 1
            coloured = _image(bits, size, 1, False)
            palette = np.cumsum(coloured[:, None] >> np.array([24, 16, 8, 0], np.uint32) & 255, axis=0, dtype=np.uint32) & 255
            palette = (palette << np.array([24, 16, 8, 0], np.uint32)).sum(axis=1).astype(np.uint32)
            steps.append((kind, palette, 0, coded))
            coded = -(-coded // (8 if size <= 2 else 4 if size <= 4 else 2 if size <= 16 else 1))
    image = _image(bits, coded, height, True)
    for kind, part, size, across in reversed(steps):
        if kind == 0:
            image = _undo_predictor(image, part, size, across, height)
        elif kind == 1:
            image = _undo_cross(image, part, size, across, height)
        elif kind == 2:
            image = _undo_green(image)
        else:
            image = _undo_palette(image, part, across, height)
    return image.reshape(height, width)


def decode_file(data: bytes) -> np.ndarray:
    """Height x width ARGB pixels of a WebP file with a VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return decode_vp8l(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])


#: Pixels that a back-reference repeats at least and at most; bytes whose codes the lengths take; the first length prefix; the farthest distance.
LEAST_COPY, MOST_COPY, FIRST_MARK, FIRST_LENGTH, FARTHEST = 17, 768, 0xF5, 8, (1 << 20) - 120
#: Colours up to which an image has a palette.
MOST_COLOURS = 16


class Put:
    """Collects bits, lowest first, as parts of one array."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def value(self, value: int, n: int) -> None:
        self.parts.append((value >> np.arange(n) & 1).astype(bool))

    def described(self, lengths: list[int], own: dict[int, int]) -> None:
        """A code by its lengths; ``own`` has the code lengths of the lengths used, runs of zeros (17, 18) among them."""
        table = np.zeros(19, np.int64)
        table[list(own)] = list(own.values())
        codes = reversed_codes(table)
        self.value(0, 1), self.value(len(LENGTH_ORDER) - 4, 4)
        for k in LENGTH_ORDER:
            self.value(int(table[k]), 3)
        self.value(0, 1)
        at = 0
        while at < len(lengths):
            zeros = 0
            while at + zeros < len(lengths) and not lengths[at + zeros]:
                zeros += 1
            s, n, extra = (18, min(zeros, 138), 7) if zeros >= 11 else (17, zeros, 3) if zeros >= 3 else (lengths[at], 1, 0)
            self.value(int(codes[s]), own[s])
            if extra:
                self.value(n - (11 if s == 18 else 3), extra)
            at += n

    def flat(self, size: int) -> None:
        """A code of 8 bits for each of the first 256 of ``size`` symbols."""
        self.value(0, 1), self.value(len(LENGTH_ORDER) - 4, 4)
        for k in LENGTH_ORDER:
            self.value(int(k == 8), 3)
        if size > 256:
            self.value(1, 1), self.value(3, 3), self.value(254, 8)
        else:
            self.value(0, 1)

    def one(self, symbol: int, other: int | None = None) -> None:
        """A code of one symbol, or of two with a bit each."""
        self.value(1, 1), self.value(int(other is not None), 1), self.value(1, 1), self.value(symbol, 8)
        if other is not None:
            self.value(other, 8)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their number) of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    w = value - 1
    high = w.bit_length() - 1
    return 2 * high + (w >> (high - 1) & 1), w & ((1 << (high - 1)) - 1), high - 1


@functools.lru_cache(maxsize=2)
def sample_code(references: bool) -> tuple:
    """(bits of the byte codes, their mask, codes and lengths of distances, header bits of the five codes) of the sample encoder."""
    lengths = np.full(256, 10, np.int64)
    lengths[list(FIVE_BITS)], lengths[list(NINE_BITS)] = 5, 9
    each = (reversed_codes(lengths)[:, None] >> np.arange(10) & 1).astype(bool)
    far = np.array([6] * 16 + [5] * 24)
    put = Put()
    put.value(0, 3)  # no transform, no colour cache, one group of prefix codes
    own = {10: 1, 5: 2, 9: 3, 17: 4, 18: 4}
    # Green's lengths of references stand where red and blue have the last bytes: their codes are the same.
    marks = 256 - FIRST_MARK
    green = [*lengths[:FIRST_MARK].tolist(), *[0] * (marks + FIRST_LENGTH), *[10] * marks, *[0] * (24 - FIRST_LENGTH - marks)] if references else [*lengths.tolist(), *[0] * 24]
    put.described(green, own)
    for _ in range(2):
        put.described(lengths.tolist(), own)
    put.one(255)
    if references:
        put.described(far.tolist(), {5: 1, 6: 1})
    else:
        put.one(0)
    return each, np.arange(10) < lengths[:, None], reversed_codes(far), far, np.concatenate(put.parts)


def copies(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, pixels, distance) of the back-references of an image: from left to right, each to the nearest earlier place that starts alike."""
    n = len(pixels) - LEAST_COPY + 1
    if n < 2:
        return []
    # A hash of 17 pixels, doubled up from one; what it finds is compared.
    with np.errstate(over="ignore"):
        h, factor = (pixels.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        one, step = h, 1
        while step < 16:
            h = (h[: len(h) - step] ^ h[: len(h) - step] >> np.uint64(31)) * factor + h[step:]
            step *= 2
        h = (h[:n] ^ h[:n] >> np.uint64(29)) * factor + one[16 : 16 + n]
    order = np.argsort(h, kind="stable")
    alike = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(alike):
        return []
    before = np.full(n, -1)
    before[order[alike + 1]] = order[alike]
    places, out, at, k = np.flatnonzero(before >= 0), [], 0, 0
    while k < len(places):
        i = int(places[k])
        j = int(before[i])
        most = min(MOST_COPY, len(pixels) - i)
        unlike = np.flatnonzero(pixels[i : i + most] != pixels[j : j + most])
        many = int(unlike[0]) if len(unlike) else most
        if many < LEAST_COPY or i - j > FARTHEST:
            k += 1
            continue
        out.append((i, many, i - j))
        at = i + many
        k = int(np.searchsorted(places, at))
    return out


def _with_palette(put: Put, pixels: np.ndarray, height: int, width: int) -> None:
    """The image as bundled indices into its colours, which are stored as differences."""
    colours, index = np.unique(pixels, return_inverse=True)
    put.value(1, 1), put.value(3, 2), put.value(len(colours) - 1, 8)
    put.value(0, 1)  # no cache
    put.flat(280), put.flat(256), put.flat(256)
    put.one(255, 0) if len(colours) > 1 else put.one(255)
    put.one(0)
    rgb = colours[:, None] >> np.array([8, 16, 0]) & 255
    steps = np.diff(rgb, axis=0, prepend=0) & 255
    flat = reversed_codes(np.full(256, 8))
    # Two symbols of one bit: the smaller has the code 0.
    for k, row in enumerate(steps.tolist()):
        for v in row:
            put.value(int(flat[v]), 8)
        if len(colours) > 1:
            put.value(int(k == 0), 1)
    each = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2
    across = -(-width // each)
    full = np.zeros((height, across * each), np.int64)
    full[:, :width] = index.reshape(height, width)
    bundled = (full.reshape(height, across, each) << (8 // each * np.arange(each))).sum(axis=2).ravel()
    put.value(0, 3)  # no further transform, no cache, one group
    put.flat(280), put.one(0), put.one(0), put.one(255), put.one(0)
    put.parts.append((flat[bundled][:, None] >> np.arange(8) & 1).astype(bool).ravel())


def encode_samples(samples: np.ndarray) -> bytes:
    """A WebP file of height x width x 3 (red, green, blue) 8-bit samples."""
    height, width, _ = samples.shape
    put = Put()
    put.value(0x2F | (width - 1) << 8 | (height - 1) << 22, 40)
    r, g, b = samples.reshape(-1, 3).astype(np.uint32).T
    pixels = r << 16 | g << 8 | b
    few = len(np.unique(pixels[:64])) <= MOST_COLOURS and len(np.unique(pixels)) <= MOST_COLOURS
    if few:
        _with_palette(put, pixels, height, width)
    else:
        references = bool(samples.max() < FIRST_MARK)
        each, mask, far, far_bits, header = sample_code(references)
        put.parts.append(header)
        symbols = samples.reshape(-1, 3)[:, [1, 0, 2]].ravel()

        def literals(low: int, high: int) -> None:
            for s in range(3 * low, 3 * high, 65_536):
                block = symbols[s : min(3 * high, s + 65_536)]
                put.parts.append(each[block][mask[block]])

        at = 0
        for place, many, distance in copies(pixels) if references else []:
            literals(at, place)
            prefix, extra, n = _prefix_of(many)
            put.parts.append(each[FIRST_MARK + prefix - FIRST_LENGTH][:10])
            put.value(extra, n)
            prefix, extra, n = _prefix_of(distance + 120)
            put.value(int(far[prefix]), int(far_bits[prefix])), put.value(extra, n)
            at = place + many
        literals(at, len(pixels))
    body = put.bytes()
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


def encode_payload(payload: bytes) -> list[bytes]:
    """WebP files of 64 columns that hold ``payload``, a positive multiple of 192 bytes, in order."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return [encode_samples(rows[s : s + MAX_HEIGHT]) for s in range(0, len(rows), MAX_HEIGHT)]


def read_samples(files: list[bytes]) -> np.ndarray:
    """Rows x 64 x 3 samples of the files of one payload."""
    images = [decode_file(f) for f in files]
    return np.concatenate([np.stack([p >> 16 & 255, p >> 8 & 255, p & 255], axis=2).astype(np.uint8) for p in images])


def average_hash(samples: np.ndarray) -> str:
    """64 bits, as hex: which cells of an 8 x 8 grid are brighter than the whole image."""
    grey = samples.astype(np.int64).sum(axis=2)
    rows = np.minimum(np.arange(8) * len(grey) // 8, len(grey) - 1)
    sums = np.add.reduceat(grey.reshape(len(grey), 8, 8).sum(axis=2), np.unique(rows), axis=0)
    many = np.diff([*np.unique(rows), len(grey)])
    cells = (sums * len(grey) * 64 > grey.sum() * (many[:, None] * 8))[np.searchsorted(np.unique(rows), rows)]
    return np.packbits(cells.ravel()).tobytes().hex()


def _store(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from corelode.llm.common import byte_texts

    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            texts = byte_texts(part.column(1))
            media = [encode_payload(t + b" " * (max(ROW_BYTES, -(-len(t) // ROW_BYTES) * ROW_BYTES) - len(t))) for t in texts]
            columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (id, n_bytes, media array<binary>): each text as lossless WebP files.

    A null text is stored as an empty one (192 spaces); texts longer than one image (3 MB) take
    several files; repeated rows are stored each; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return written(rows.mapInArrow(_store, f"id {kind}, n_bytes long, media array<binary>"), "media")


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            rows = []
            for files in part.column(2).to_pylist():
                samples = read_samples(files)
                payload, stored = samples.tobytes(), b"".join(files)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), average_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cells = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(media: DataFrame) -> DataFrame:
    """Digests and a feature of each row of a media table, from its stored bytes read back."""
    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(
        _read,
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def _pixels(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            part = batch.slice(s, 64)
            images = [read_samples(files) for files in part.column(1).to_pylist()]
            columns = [pa.array([len(x) for x in images], pa.int32()), pa.array([x.shape[1] for x in images], pa.int32()), pa.array([x.tobytes() for x in images], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "height", "width", "samples"])


def pixel_arrays(media: DataFrame) -> DataFrame:
    """(id, height, width, samples): the decoded pixels of each row of a media table, row by row, red, green and blue byte of each."""
    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(_pixels, f"id {kind}, height int, width int, samples binary")
