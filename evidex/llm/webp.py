"""Media columns: lossless WebP, read.

The reader takes the whole lossless format: prefix codes (simple and normal) by groups, back-references,
the colour cache, and the inverse of the predictor, cross-colour, subtract-green and palette transforms.
Headers are read one by one; the pixels of many images are then decoded in lockstep, one pixel of each
image at a step, so that arrays and not single symbols pass through Python. Files come from
:mod:`.webp_writer`, which stores bytes as the four 8-bit samples (red, green, blue, alpha) of pixels,
as several images one behind the other where one does not hold them; each image's header tells its length.

Defined results: a null text is empty and is stored as 64 zero bytes; repeated rows give repeated results;
an empty table gives an empty table; other columns are not read. Work is local to a row, with memory in
proportion to the longest text; equal texts give equal values, whatever stands beside them.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

UNIT = 64
#: Images that are decoded in lockstep, and texts handled at a time.
LANES, TEXTS = 1024, 512

# Fixed values of the format: the order of code length codes, and the near places of short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
GREEN, LENGTHS, DISTANCES, HASH = 256, 24, 40, 0x1E35A7BD

class Bits:
    """Bits of bytes, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        return int.from_bytes(self.data[lo:hi], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out


@functools.cache
def mirrored(n: int) -> np.ndarray:
    """The numbers below 2 ** n with their n bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def tables_of(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical prefix codes, each given by its symbols' lengths, as tables over the next bits, one behind the other.

    The entries (symbol << 4 | length), and each code's start and mask. One symbol alone takes no bit.
    """
    starts, masks, parts, at = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), [], 0
    sizes = np.array([len(c) for c in codes])
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        lengths = np.frombuffer(b"".join([codes[i] for i in which.tolist()]), np.uint8).reshape(-1, size)
        columns = np.flatnonzero(lengths.any(axis=0))
        if not len(columns):
            columns = np.zeros(1, np.int64)
        own = np.where(lengths[:, columns] > 0, lengths[:, columns], 16).astype(np.int8)
        order = np.argsort(own, axis=1, kind="stable")
        own = np.take_along_axis(own, order, 1).astype(np.int64)
        used = own < 16
        deep = np.where(used, own, 0).max(1)
        alone = used.sum(1) < 2
        entries = np.where(alone[:, None], np.where(used, columns[order], 0) << 4, columns[order] << 4 | own)
        times = np.where(used, 1 << np.maximum(0, deep[:, None] - own), 0)
        times[alone], deep[alone] = 0, 0
        times[alone, 0] = 1
        if (times.sum(1) != 1 << deep).any():
            raise ValueError("a prefix code that is not complete")
        flat = np.repeat(entries.astype(np.int32).ravel(), times.ravel())
        begin = np.cumsum(1 << deep) - (1 << deep)
        for d in np.unique(deep).tolist():
            rows = np.flatnonzero(deep == d)
            parts.append(flat[begin[rows][:, None] + mirrored(d)].ravel())
            starts[which[rows]], masks[which[rows]] = at + (np.arange(len(rows)) << d), (1 << d) - 1
            at += len(rows) << d
    return np.concatenate(parts), starts, masks


@functools.lru_cache(1 << 14)
def _short(lengths: bytes) -> list[int]:
    """The table of one code of few symbols."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] << 4 if used else 0]
    deep = used[-1][0]
    flat = [s << 4 | n for n, s in used for _ in range(1 << (deep - n))]
    if len(flat) != 1 << deep:
        raise ValueError("a prefix code that is not complete")
    return [flat[i] for i in _mirrored_list(deep)]


@functools.cache
def _mirrored_list(n: int) -> list[int]:
    return mirrored(n).tolist()


def _prefix(bits: Bits, size: int) -> bytes:
    """The lengths of a code's symbols."""
    lengths = bytearray(size)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return bytes(lengths)
    own, n = [0] * len(LENGTH_ORDER), 4 + bits.read(4)
    near = bits.read(3 * n)
    for k in LENGTH_ORDER[:n]:
        own[k] = near & 7
        near >>= 3
    code, left = _short(bytes(own)), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    # bits ahead as one number that is used up from below
    near, mask, gone, ahead = 0, len(code) - 1, 0, 0
    at, last = 0, 8
    while at < size and left:
        left -= 1
        if gone >= ahead:
            bits.at += gone
            near, gone, ahead = bits.peek(256 + 16), 0, 256
        e = code[near & mask]
        n = e & 15
        near >>= n
        gone += n
        if e < 256:
            if k := e >> 4:
                lengths[at] = last = k
            at += 1
            continue
        n, value, least = ((2, last, 3), (3, 0, 3), (7, 0, 11))[(e >> 4) - 16]
        times = least + (near & (1 << n) - 1)
        near >>= n
        gone += n
        if value:
            lengths[at : at + times] = bytes([value]) * times
        at += times
    bits.at += gone
    if at > size:
        raise ValueError("more code lengths than symbols")
    return bytes(lengths)


def _extended(bits: Bits, k: int) -> int:
    if k < 4:
        return k + 1
    extra = (k - 2) >> 1
    return ((2 + (k & 1)) << extra) + bits.read(extra) + 1


def _ceil(a: int, bits: int) -> int:
    return (a + (1 << bits) - 1) >> bits


@dataclass
class Coded:
    """An image whose header is read: its codes, and where its pixels begin."""

    data: bytes
    width: int
    height: int
    at: int = 0
    cache_bits: int = 0
    group_bits: int = 0
    groups_of: list[int] | None = None
    codes: list[list[bytes]] = field(default_factory=list)
    undo: list[tuple[str, Callable]] = field(default_factory=list)

    @property
    def n(self) -> int:
        return self.width * self.height


def _codes(bits: Bits, width: int, height: int, outer: bool) -> Coded:
    out = Coded(bits.data, width, height, cache_bits=bits.read(4) if bits.read(1) else 0)
    groups = 1
    if outer and bits.read(1):
        out.group_bits = bits.read(3) + 2
        out.groups_of = (_small(bits, _ceil(width, out.group_bits), _ceil(height, out.group_bits)) >> 8 & 0xFFFF).tolist()
        groups = max(out.groups_of) + 1
    sizes = (GREEN + LENGTHS + (1 << out.cache_bits if out.cache_bits else 0), 256, 256, 256, DISTANCES)
    out.codes = [[_prefix(bits, n) for n in sizes] for _ in range(groups)]
    out.at = bits.at
    return out


def _small(bits: Bits, width: int, height: int) -> np.ndarray:
    """The ARGB values of an image inside a header, flat: read pixel by pixel."""
    coded = _codes(bits, width, height, False)
    own, n = [_short(c) for c in coded.codes[0]], coded.n
    out, cache = [], [0] * (1 << coded.cache_bits)

    def read(k: int) -> int:
        e = own[k][bits.peek(15) & (len(own[k]) - 1)]
        bits.at += e & 15
        return e >> 4

    def put(pixel: int) -> None:
        out.append(pixel)
        if coded.cache_bits:
            cache[(HASH * pixel & 0xFFFFFFFF) >> (32 - coded.cache_bits)] = pixel

    while (at := len(out)) < n:
        green = read(0)
        if green < GREEN:
            red, blue, alpha = read(1), read(2), read(3)
            put(alpha << 24 | red << 16 | green << 8 | blue)
        elif green < GREEN + LENGTHS:
            times = _extended(bits, green - GREEN)
            back = _extended(bits, read(4))
            if back > len(NEAR):
                back -= len(NEAR)
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > at or at + times > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(times):
                put(out[-back])
        else:
            put(cache[green - GREEN - LENGTHS])
    return np.array(out, np.uint32)


class Lanes:
    """Images decoded in lockstep, the largest first, so that those with pixels left are always in front."""

    def __init__(self, images: list[Coded]):
        self.images, self.met = images, Counter()
        self.n = np.array([x.n for x in images])
        self.width = np.array([x.width for x in images])
        sizes = [len(x.data) + 8 for x in images]
        base = 8 * np.cumsum([0, *sizes])
        data = np.frombuffer(b"".join(b for x in images for b in (x.data, b"\0" * 8)) + b"\0" * 16, np.uint8)
        #: The 64 bits that begin at each byte; 57 of them are sure to be there from any bit of it on.
        self.words = np.ndarray((len(data) - 8,), "<i8", data, strides=(1,))
        self.at = base[:-1] + [x.at for x in images]
        self.end = base[:-1] + [8 * len(x.data) for x in images]
        sets = [s for x in images for s in x.codes]
        self.flat, starts, masks = tables_of([c for s in sets for c in s])
        self.met["prefix"] = int((masks > 0).sum())
        starts, masks = starts.reshape(-1, 5).T, masks.reshape(-1, 5).T
        first = np.cumsum([0, *(len(x.codes) for x in images)])[:-1]
        self.starts, self.masks = np.ascontiguousarray(starts[:, first]), np.ascontiguousarray(masks[:, first])
        self.grouped = [(i, x, starts[:, first[i] :], masks[:, first[i] :]) for i, x in enumerate(images) if x.groups_of]
        #: Whether the 57 bits of a word hold all four symbols of a literal.
        self.narrow = 4 * int(masks.max()).bit_length() <= 57
        self.shift = np.array([32 - x.cache_bits for x in images])
        self.cached = np.flatnonzero(self.shift < 32)
        self.cache = np.zeros((len(images), 1 << max(x.cache_bits for x in images)), np.int64)
        self.left, self.back = np.zeros(len(images), np.int64), np.zeros(len(images), np.int64)

    def _word(self, lane):
        at = self.at[lane]
        return self.words[at >> 3] >> (at & 7)

    def _symbols(self, lane, word, k: int):
        """The next symbols of code k, and the words behind them."""
        e = self.flat[self.starts[k][lane] + (word & self.masks[k][lane])]
        n = e & 15
        self.at[lane] += n
        return e >> 4, word >> n

    def _extended(self, lane, k):
        extra = np.maximum(0, (k - 2) >> 1)
        low = self._word(lane) & ((1 << extra) - 1)
        self.at[lane] += extra
        return np.where(k < 4, k + 1, ((2 + (k & 1)) << extra) + low + 1)

    def _copies(self, lane, k, at: int) -> None:
        times = self._extended(lane, k)
        symbol, _ = self._symbols(lane, self._word(lane), 4)
        back = self._extended(lane, symbol)
        x, y = _NEAR[:, np.minimum(back, len(NEAR)) - 1]
        back = np.where(back > len(NEAR), back - len(NEAR), np.maximum(1, x + y * self.width[lane]))
        if (back > at).any() or (at + times > self.n[lane]).any():
            raise ValueError("a back-reference leaves the image")
        self.left[lane], self.back[lane] = times, back
        self.met["copies"] += len(lane)

    def run(self) -> list[np.ndarray]:
        """The ARGB values of each image.

        A step looks up a literal's four symbols for all images in front, and lets only those go on behind them that have one.
        """
        out, k = np.zeros((int(self.n[0]), len(self.n)), np.int64), len(self.n)
        copying = False
        for t in range(len(out)):
            while self.n[k - 1] <= t:
                k -= 1
            for i, x, starts, masks in self.grouped:
                if t < x.n:
                    g = x.groups_of[(t // x.width >> x.group_bits) * _ceil(x.width, x.group_bits) + (t % x.width >> x.group_bits)]
                    self.starts[:, i], self.masks[:, i] = starts[:, g], masks[:, g]
            now, at, starts, masks = out[t, :k], self.at[:k], self.starts[:, :k], self.masks[:, :k]
            word = self.words[at >> 3] >> (at & 7)
            e = self.flat[starts[0] + (word & masks[0])]
            green, own = e >> 4, e & 15
            word = word >> own
            plain, gone, symbols = green < GREEN, 0, []
            for c in (1, 2, 3):
                if c == 3 and not self.narrow:
                    behind = at + own + gone
                    word = self.words[behind >> 3] >> (behind & 7)
                e = self.flat[starts[c] + (word & masks[c])]
                n = e & 15
                symbols.append(e >> 4)
                word = word >> n
                gone = gone + n
            red, blue, alpha = symbols
            now[:] = alpha.astype(np.int64) << 24 | red << 16 | green << 8 | blue
            idle = self.left[:k] > 0 if copying else None
            if copying:
                plain &= ~idle
                own[idle] = 0
            at += own + plain * gone
            if not plain.all():
                lane = np.flatnonzero(~plain if idle is None else ~(plain | idle))
                code = green[lane]
                held = code >= GREEN + LENGTHS
                now[lane[held]] = self.cache[lane[held], code[held] - GREEN - LENGTHS]
                self.met["cached"] += int(held.sum())
                if not held.all():
                    self._copies(lane[~held], code[~held] - GREEN, t)
                    copying = True
            if copying:
                lane = np.flatnonzero(self.left[:k])
                now[lane] = out[t - self.back[lane], lane]
                self.left[lane] -= 1
                copying = bool(self.left[:k].any())
            if len(self.cached):
                lane = self.cached[: np.searchsorted(self.cached, k)]
                self.cache[lane, (HASH * now[lane] & 0xFFFFFFFF) >> self.shift[lane]] = now[lane]
        if (self.at > self.end).any():
            raise ValueError("the data end before the pixels do")
        return [out[: x.n, i].astype(np.uint32) for i, x in enumerate(self.images)]


_NEAR = np.array(NEAR).T


def _split(argb: np.ndarray) -> list[np.ndarray]:
    return [(argb >> k & 0xFF).astype(np.int32) for k in (24, 16, 8, 0)]


def _join(a, r, g, b) -> np.ndarray:
    a, r, g, b = ((x & 0xFF).astype(np.uint32) for x in (a, r, g, b))
    return a << 24 | r << 16 | g << 8 | b


def _blocks(image: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """For each pixel, the value of the block that it lies in."""
    rows, cols = np.arange(height) >> bits, np.arange(width) >> bits
    return image.reshape(-1, _ceil(width, bits))[np.ix_(rows, cols)]


def _predict(mode: int, left, top, right, corner):
    """The prediction of a pixel from its neighbours, each (alpha, red, green, blue)."""

    def mean(p, q):
        return [x + y >> 1 for x, y in zip(p, q)]

    def held(p):
        return [min(255, max(0, x)) for x in p]

    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        return left if to_left < sum(abs(p - c) for p, c in zip(left, corner)) else top
    if mode == 12:
        return held(p + t - c for p, t, c in zip(left, top, corner))
    if mode == 13:
        return held(m + int((m - c) / 2) for m, c in zip(mean(left, top), corner))
    return [255, 0, 0, 0]


def undo_predictor(argb, width, height, modes):
    if (only := modes.flat[0] >> 8 & 0xF) in (1, 2) and (modes == modes.flat[0]).all():
        # all from the left, or all from above: sums along rows or columns, but for the first column or row
        x = np.stack(_split(argb)).reshape(4, height, width)
        x[0, 0, 0] += 255
        edge = np.s_[:, :, 0] if only == 1 else np.s_[:, 0]
        x[edge] = np.cumsum(x[edge], axis=1)
        return _join(*np.cumsum(x, axis=2 if only == 1 else 1).reshape(4, -1))
    out = []
    for i, (rest, mode) in enumerate(zip(zip(*(x.tolist() for x in _split(argb))), (modes >> 8 & 0xF).ravel().tolist())):
        y, x = divmod(i, width)
        if i == 0:
            guess = [255, 0, 0, 0]
        elif y == 0 or x == 0:
            guess = out[i - 1] if y == 0 else out[i - width]
        else:
            guess = _predict(mode, out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out.append([p + q & 0xFF for p, q in zip(rest, guess)])
    return _join(*np.array(out, np.int32).T)


def undo_cross_colour(argb, blocks):
    a, r, g, b = _split(argb)
    _, red_to_blue, green_to_blue, green_to_red = (x.astype(np.int8).astype(np.int32) for x in _split(blocks.ravel()))

    def delta(t, c):
        return t * (c & 0xFF).astype(np.int8).astype(np.int32) >> 5

    r = r + delta(green_to_red, g) & 0xFF
    return _join(a, r, g, b + delta(green_to_blue, g) + delta(red_to_blue, r))


def undo_green(argb):
    a, r, g, b = _split(argb)
    return _join(a, r + g, g, b + g)


def undo_palette(argb, width, height, table, packed):
    index = (argb >> 8 & 0xFF).reshape(height, -1)
    if packed:
        each = 8 >> packed
        index = (index[:, :, None] >> (np.arange(1 << packed, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


def parse(data: bytes) -> tuple[Coded, int]:
    """An image's header, and the bytes that the image takes."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP image")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    bits = Bits(data[20 : 20 + struct.unpack_from("<I", data, 16)[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless WebP image")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("a version of the format that is not known")
    coded, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            size = bits.read(3) + 2
            blocks = _blocks(_small(bits, _ceil(coded, size), _ceil(height, size)), coded, height, size)
            if kind == 0:
                undo.append(("predictor", lambda p, w=coded, b=blocks: undo_predictor(p, w, height, b)))
            else:
                undo.append(("cross_colour", lambda p, b=blocks: undo_cross_colour(p, b)))
        elif kind == 2:
            undo.append(("subtract_green", undo_green))
        else:
            n = bits.read(8) + 1
            table = _join(*(np.cumsum(x) for x in _split(_small(bits, n, 1))))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(("palette", lambda p, w=coded, t=table, k=packed: undo_palette(p, w, height, t, k)))
            coded = _ceil(coded, packed)
    out = _codes(bits, coded, height, True)
    out.undo = undo
    return out, end + (end & 1)


def samples_of(images: list[Coded], met: Counter | None = None) -> list[np.ndarray]:
    """Each image's pixels as rows of red, green, blue, alpha; ``met`` counts the steps that were taken."""
    order, out = sorted(range(len(images)), key=lambda i: -images[i].n), [None] * len(images)
    for k in range(0, len(order), LANES):
        some = order[k : k + LANES]
        lanes = Lanes([images[i] for i in some])
        for i, pixels in zip(some, lanes.run()):
            for name, undo in reversed(images[i].undo):
                pixels = undo(pixels)
                if met is not None:
                    met[name] += 1
            out[i] = pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, (2, 1, 0, 3)]
        if met is not None:
            met.update(lanes.met)
    return out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """An image as an array (height, width, 4) of red, green, blue, alpha; and the bytes it takes."""
    image, end = parse(data)
    return samples_of([image])[0].reshape(image.height, -1, 4), end


def read(media: list[bytes], met: Counter | None = None) -> list[np.ndarray]:
    """The samples of each of ``media``, whose images stand one behind the other; ``LANES`` images are open at a time."""
    places = []
    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            places.append((i, at, at + size))
            at += size + (size & 1)
    parts = [[] for _ in media]
    for k in range(0, len(places), LANES):
        some = places[k : k + LANES]
        for (i, _, _), x in zip(some, samples_of([parse(media[i][lo:hi])[0] for i, lo, hi in some], met)):
            parts[i].append(x)
    return [np.concatenate(p) if p else np.empty((0, 4), np.uint8) for p in parts]


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def feature(samples: np.ndarray) -> str:
    """Samples' mean and deviation by channel, entropy, distinct values and mean step along rows, of (n, 4) samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / counts.sum()
    steps = np.abs(np.diff(samples.astype(np.int16), axis=0)).mean() if len(samples) > 1 else 0.0
    values = [*samples.mean(axis=0), *samples.std(axis=0), -(p * np.log2(p)).sum(), steps]
    return ",".join([f"{x + 0.0:.4f}" for x in values] + [str(len(p))])


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; the media if asked for.

    All that speaks of the payload comes from the stored bytes, decoded again.
    """

    def start():
        from . import webp_writer

        def step(ids, texts):
            data = [(t or "").encode() for t in texts]
            held = webp_writer.stored([padded(d) for d in data])
            rows = []
            for i, d, h, samples in zip(ids, data, held, read(held)):
                back = samples.tobytes()
                rows.append((i, len(d), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(h), hashlib.sha256(h).hexdigest(), feature(samples), *([h] if with_media else [])))
            return list(zip(*rows))

        return step

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], start, schema, TEXTS)
