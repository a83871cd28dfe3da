"""A writer of lossless WebP for tests that uses what the library's own writer leaves out."""

import heapq
import struct
from collections import Counter

import numpy as np

from evidex.llm.webp import HASH, LENGTH_ORDER, NEAR, _predict


class Out:
    def __init__(self):
        self.bits, self.n = 0, 0

    def put(self, value, count):
        self.bits |= int(value) << self.n
        self.n += count

    def data(self):
        return self.bits.to_bytes((self.n + 7) // 8, "little")


def lengths_of(counts, size, most):
    """Code lengths of at most ``most`` bits."""
    used = {s: c for s, c in counts.items() if c}
    out = [0] * size
    if len(used) == 1:
        out[next(iter(used))] = 1
        return out
    while used:
        heap = [(c, s, (s,)) for s, c in used.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            (c, s, a), (d, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for x in a + b:
                depth[x] += 1
            heapq.heappush(heap, (c + d, s, a + b))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            return out
        used = {s: c // 2 + 1 for s, c in used.items()}
    return out


def codes_of(lengths):
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return {next(iter(out)): (0, 0)} if len(out) == 1 else out


def put_prefix(out, counts, size, simple):
    used = sorted(s for s, c in counts.items() if c) or [0]
    if simple and len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    lengths = lengths_of(Counter({s: max(1, counts[s]) for s in used}), size, 15)
    runs, at = [], 0
    while at < size:
        k = at
        while k < size and lengths[k] == lengths[at] and k - at < 138:
            k += 1
        n = k - at
        if lengths[at] == 0 and n >= 11:
            runs.append((18, n - 11, 7))
        elif lengths[at] == 0 and n >= 3:
            n = min(n, 10)
            runs.append((17, n - 3, 3))
        elif at and lengths[at] == lengths[at - 1] and lengths[at] and n >= 3:
            n = min(n, 6)
            runs.append((16, n - 3, 2))
        else:
            n = 1
            runs.append((lengths[at], 0, 0))
        at += n
    own = lengths_of(Counter(r[0] for r in runs), 19, 7)
    own_codes = codes_of(own)
    out.put(0, 1)
    out.put(15, 4)
    for k in LENGTH_ORDER:
        out.put(own[k], 3)
    out.put(0, 1)
    for k, extra, n in runs:
        out.put(*own_codes[k])
        out.put(extra, n)
    return codes_of(lengths)


def split_value(v):
    """A prefix symbol with its extra bits for a length or distance from 1."""
    v -= 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    n = high - 1
    return 2 * high + second, v & ((1 << n) - 1), n


def put_image(out, pixels, width, outer, cache_bits=0, group_bits=0, back=True, simple=True):
    """pixels: flat ARGB numbers."""
    pixels = [int(p) for p in pixels]
    symbols, cache, seen, at = [], [None] * (1 << cache_bits), {}, 0
    near = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}

    def remember(p):
        if cache_bits:
            cache[(HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while at < len(pixels):
        key, start = tuple(pixels[at : at + 3]), None
        if back and len(key) == 3:
            start = seen.get(key)
        if start is not None:
            n = 0
            while at + n < len(pixels) and pixels[start + n] == pixels[at + n] and n < 4096:
                n += 1
            d = at - start
            symbols.append((at, "copy", n, near.get(d, d + len(NEAR))))
        else:
            n, p = 1, pixels[at]
            k = (HASH * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            symbols.append((at, "cache", k) if cache_bits and cache[k] == p else (at, "literal", p))
        for i in range(at, at + n):
            seen[tuple(pixels[i : i + 3])] = i
            remember(pixels[i])
        at += n
    out.put(int(bool(cache_bits)), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    across = -(-width >> group_bits)
    height = len(pixels) // width

    def group(i):
        return ((i // width >> group_bits) * across + (i % width >> group_bits)) % 3 if group_bits else 0

    if outer:
        out.put(int(bool(group_bits)), 1)
        if group_bits:
            out.put(group_bits - 2, 3)
            n = (-(-width >> group_bits)) * (-(-height >> group_bits))
            put_image(out, [(i % 3) << 8 for i in range(n)], across, False)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    n_groups = min(3, (-(-width >> group_bits)) * (-(-height >> group_bits))) if group_bits else 1
    stats = [[Counter() for _ in range(5)] for _ in range(n_groups)]
    for s in symbols:
        c = stats[group(s[0])]
        if s[1] == "literal":
            for k, sh in enumerate((8, 16, 0, 24)):
                c[k][s[2] >> sh & 255] += 1
        elif s[1] == "cache":
            c[0][280 + s[2]] += 1
        else:
            c[0][256 + split_value(s[2])[0]] += 1
            c[4][split_value(s[3])[0]] += 1
    tables = [[put_prefix(out, c, n, simple) for c, n in zip(own, (size, 256, 256, 256, 40))] for own in stats]
    for s in symbols:
        t = tables[group(s[0])]
        if s[1] == "literal":
            for k, sh in enumerate((8, 16, 0, 24)):
                out.put(*t[k][s[2] >> sh & 255])
        elif s[1] == "cache":
            out.put(*t[0][280 + s[2]])
        else:
            for value, k, base in ((s[2], 0, 256), (s[3], 4, 0)):
                symbol, extra, n = split_value(value)
                out.put(*t[k][base + symbol])
                out.put(extra, n)


def parts(p):
    return [p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255]


def whole(a, r, g, b):
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255


def blocks(width, height, bits, make):
    w, h = -(-width >> bits), -(-height >> bits)
    return [make(i) for i in range(w * h)], w


def write(samples, transforms=(), **options):
    """transforms: of "predictor", "cross", "green", "palette", in order."""
    height, width = samples.shape[:2]
    pixels = [whole(a, r, g, b) for r, g, b, a in samples.reshape(-1, 4).tolist()]
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for t in transforms:
        out.put(1, 1)
        if t == "green":
            out.put(2, 2)
            pixels = [whole(a, r - g, g, b - g) for a, r, g, b in map(parts, pixels)]
        elif t == "cross":
            table, w = blocks(width, height, 2, lambda i: whole(255, i * 37, i * 91, i * 53))
            out.put(1, 2)
            out.put(0, 3)
            put_image(out, table, w, False)
            signed = lambda v: v - 256 if v > 127 else v
            delta = lambda t, c: signed(t) * signed(c) >> 5
            new = []
            for i, p in enumerate(pixels):
                a, r, g, b = parts(p)
                _, r2b, g2b, g2r = parts(table[(i // width >> 2) * w + (i % width >> 2)])
                new.append(whole(a, r - delta(g2r, g), g, b - delta(g2b, g) - delta(r2b, r)))
            pixels = new
        elif t == "predictor":
            modes, w = blocks(width, height, 2, lambda i: whole(255, 0, i % 14, 0))
            out.put(0, 2)
            out.put(0, 3)
            put_image(out, modes, w, False)
            new = []
            for i, p in enumerate(pixels):
                y, x = divmod(i, width)
                at = lambda k: parts(pixels[k])
                if i == 0:
                    guess = [255, 0, 0, 0]
                elif y == 0 or x == 0:
                    guess = at(i - 1 if y == 0 else i - width)
                else:
                    guess = _predict(modes[(y >> 2) * w + (x >> 2)] >> 8 & 15, at(i - 1), at(i - width), at(i - width + 1), at(i - width - 1))
                new.append(whole(*(u - v for u, v in zip(parts(p), guess))))
            pixels = new
        else:
            colours = sorted(set(pixels))
            out.put(3, 2)
            out.put(len(colours) - 1, 8)
            steps = [whole(*(u - v for u, v in zip(parts(c), parts(b)))) for b, c in zip([0, *colours], colours)]
            put_image(out, steps, len(colours), False)
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index, each, new = {c: i for i, c in enumerate(colours)}, 8 >> packed, []
            for y in range(height):
                row = [index[p] for p in pixels[y * width : (y + 1) * width]]
                for k in range(0, width, 1 << packed):
                    new.append(whole(255, 0, sum(v << (each * j) for j, v in enumerate(row[k : k + (1 << packed)])), 0))
            pixels, width = new, -(-width >> packed)
    out.put(0, 1)
    put_image(out, pixels, width, True, **options)
    data = out.data()
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def picture(rng, height, width, colours):
    """A picture with runs and repeats."""
    pool = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    rows = pool[rng.integers(0, colours, (height, -(-width // 3)))].repeat(3, axis=1)[:, :width]
    rows[height // 2 :] = rows[: height - height // 2]
    return np.ascontiguousarray(rows)
