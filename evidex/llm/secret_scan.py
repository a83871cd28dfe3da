"""Secret scans by a worklist of decoded layers.

A text is the first layer. Each layer is scanned, then searched for percent escapes, Unicode escapes and
base64 runs; what these hold becomes a further layer, and so does what any compressed part of a decoded
layer holds, until none is left. A layer met before at the same place is not searched again, which ends
cycles such as archives that hold themselves. Escapes of escapes are undone one by one, and each step is a layer of its
own; from the ``DEEP``-th on, which no encoder makes and a hostile text may, all that are left are undone at once, so
that a chain of a million escapes costs no million scans.
A layer carries the place in the text of each of its
characters, so a span found anywhere is reported as the part of the text that encodes it. Patterns are
ASCII, so layers are bytes: one for each character of the text, any other than Latin-1 being a "?".
A layer need not be text, and compressed parts are found anywhere in it, one behind the other being read as one;
a deflated part without a header is found where a base64 run begins with it. Characters of two bytes, one of them NUL,
are read as one. Base64 runs of under 16 digits are too short for a secret, and are decoded for what is compressed.
Base64 is read over line ends, and from each of four digits on, so that what is glued before it does no harm.
Defined results: a null text is empty and has no spans; repeated rows give repeated results; an empty
table gives an empty table; other columns are not read. Every byte of every layer is scanned. One of
more than ``MAX_LAYER`` bytes is unpacked to a temporary file and scanned there; ``cut_layers`` counts these.
All work is local to a row: no shuffle. Memory is bounded by the longest text and ``MAX_LAYER``, the time
and the temporary file by what the layers of a text unpack to.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_replace

KINDS = ("assign", "access", "hex")
#: Bytes of a layer held in memory, and bytes handled at a time.
MAX_LAYER, CHUNK = 16 << 20, 1 << 20
#: Layers of escapes undone one by one.
DEEP = 16
MASK = "[SECRET]"

_WORDS = "password passwd secret token api_?key".split()
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", w) for w in _WORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode())
#: A match of AKIA[A-Z0-9]+ or [0-9a-f]+ is a whole run, so the least length can stand in the pattern.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(
    rb"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\u\{[0-9a-fA-F]{1,6}\}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};"
)
#: One escape of either sort; none is longer than ``REACH``.
ESCAPED, REACH = re.compile(rb"%[0-9A-Fa-f]{2}|" + UNICODE.pattern), 12
#: Digits of the shortest base64 run that can hold a secret as it is, and of one that can hold a compressed one.
PLAIN, SHORT = 16, 11
#: A run of base64 digits, or several with line ends between them.
BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:[ \t]*[\r\n][ \t\r\n]*[A-Za-z0-9+/_-]++)+|[A-Za-z0-9+/_-]{%d,}+)={0,2}" % SHORT)
_URL = bytes.maketrans(b"-_", b"+/")
#: First bytes of zlib: any window, no dictionary, and the check of the two.
ZLIB = b"|".join(b"%s[%s]" % (re.escape(bytes([a])), b"".join(re.escape(bytes([b])) for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 32)) for a in range(0x08, 0x80, 0x10))
#: First bytes of gzip, zlib, bzip2 and xz.
PACKED = re.compile(rb"\x1f\x8b\x08|" + ZLIB + rb"|BZh[1-9](?=1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
#: Some characters of two bytes, and of which of the two.
WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){6}|(?:\x00[\t\r\n\x20-\x7e]){6}")
#: What a decoded layer must have for anything to be found in it, now or further in.
HINT = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*[\r\n]|" + WIDE.pattern + b"|" + PACKED.pattern)
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True


def base_spans(text: bytes):
    """(start, kind's number, end) of each kind's leftmost matches that do not overlap."""
    low = text.lower() if isinstance(text, bytes) else None
    if low is None or b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        yield from ((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6)
    yield from ((m.start(), 1, m.end()) for m in ACCESS.finditer(text))
    yield from ((m.start(), 2, m.end()) for m in HEX.finditer(text))


class Spool:
    """Bytes put together: in memory up to MAX_LAYER, else in a temporary file."""

    def __init__(self):
        self.parts, self.size, self.file = [], 0, None

    def add(self, part: bytes) -> None:
        self.size += len(part)
        if self.file is None and self.size > MAX_LAYER:
            self.file = tempfile.TemporaryFile()
            self.file.write(b"".join(self.parts))
            self.parts = []
        self.file.write(part) if self.file else self.parts.append(part)

    def done(self) -> bytes | mmap.mmap:
        if self.file is None:
            return b"".join(self.parts)
        with self.file as f:
            f.flush()
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _unescape(match: str) -> bytes | None:
    """The characters of one Unicode escape, None if there are none such."""
    if match[0] == "&":
        code = int(match[3:-1], 16) if match[2] in "xX" else int(match[2:-1])
    elif len(match) == 12 and match[6:8] == "\\u":
        return b"?"
    else:
        code = int(match[2:].strip("{}"), 16)
    return chr(code).encode("latin-1", "replace") if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _one(match: bytes) -> bytes | None:
    """The byte of one escape, None if there is none such."""
    return bytes.fromhex(match[1:].decode()) if match[:1] == b"%" else _unescape(match.decode())


def _escapes(text: bytes, percent: bool):
    """(start, end, decoded, places): places are each decoded character's start and end in the text."""
    if not percent:
        for m in UNICODE.finditer(text):
            if (c := _unescape(m[0].decode())) is not None:
                yield m.start(), m.end(), c, [m.span()]
        return
    for m in PERCENT.finditer(text):
        yield *m.span(), bytes.fromhex(m[0].replace(b"%", b"").decode()), [(k, k + 3) for k in range(m.start(), m.end(), 3)]


class Layer:
    """A text with, for each character, the start and end of what encodes it in the first text.

    ``own`` marks the characters that decoding made; None: all of them. ``flat`` is the place of every
    character if it is the same for all, as in what was compressed.
    """

    __slots__ = ("close", "depth", "ends", "flat", "own", "starts", "text")

    def __init__(self, text, starts=None, ends=None, own=None, flat=None, close=None, depth=0):
        self.text, self.starts, self.ends, self.own, self.flat, self.close, self.depth = text, starts, ends, own, flat, close, depth

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.flat is not None:
            return self.flat
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def spans(self):
        """(start, kind's number, end) in the first text of what decoding brought to light."""
        if self.flat is not None:  # one of each kind is all that can differ
            return {(self.flat[0], k, self.flat[1]) for k, found in enumerate(self.kinds()) if found}
        return {(p[0], k, p[1]) for s, k, e in base_spans(self.text) if (self.own is None or self.own[s:e].any()) and (p := self.place(s, e))}

    def kinds(self):
        t = self.text
        return any(m.end(2) - m.start(2) >= 6 for m in ASSIGN.finditer(t)), ACCESS.search(t), HEX.search(t)

    def unescaped(self, percent: bool) -> Layer | None:
        """The whole layer with its escapes undone."""
        if self.flat is not None:
            out, at = Spool(), 0
            for lo, hi, decoded, _ in _escapes(self.text, percent):
                for k in range(at, lo, CHUNK):
                    out.add(self.text[k : min(lo, k + CHUNK)])
                out.add(decoded)
                at = hi
            if not at:
                return None
            for k in range(at, len(self.text), CHUNK):
                out.add(self.text[k : k + CHUNK])
            return Layer(out.done(), flat=self.flat, depth=self.depth + 1)
        parts, starts, ends, own, at = [], [], [], [], 0
        s, e = (self.starts, self.ends) if self.starts is not None else (np.arange(len(self.text)), np.arange(1, len(self.text) + 1))
        for lo, hi, decoded, places in _escapes(self.text, percent):
            parts += [self.text[at:lo], decoded]
            starts += [s[at:lo], s[[p[0] for p in places]]]
            ends += [e[at:lo], e[[p[1] - 1 for p in places]]]
            own += [np.zeros(lo - at, bool), np.ones(len(decoded), bool)]
            at = hi
        if not parts:
            return None
        tail = len(self.text) - at
        return Layer(b"".join([*parts, self.text[at:]]), np.concatenate([*starts, s[at:]]), np.concatenate([*ends, e[at:]]), np.concatenate([*own, np.zeros(tail, bool)]), depth=self.depth + 1)

    def settled(self) -> Layer | None:
        """The whole layer with escapes undone until none is left, in one pass: what an escape gives may belong to the next."""
        text, out, at = self.text, bytearray(), 0
        starts, ends, own = array("q"), array("q"), bytearray()

        def append(lo: int, hi: int) -> None:
            out.extend(text[lo:hi])
            if self.flat is None:
                starts.frombytes(np.ascontiguousarray(self.starts[lo:hi] if self.starts is not None else np.arange(lo, hi)).tobytes())
                ends.frombytes(np.ascontiguousarray(self.ends[lo:hi] if self.ends is not None else np.arange(lo + 1, hi + 1)).tobytes())
                own.extend(b"\0" * (hi - lo))

        while m := ESCAPED.search(text, at):
            lo, hi = m.span()
            if (made := _one(m[0])) is None:
                append(at, lo + 1)
                at = lo + 1
                continue
            append(at, lo)
            place = self.place(lo, hi)
            while made:
                at = hi
                out.extend(made)
                if self.flat is None:
                    starts.append(place[0])
                    ends.append(place[1])
                    own.append(1)
                made, base = None, max(0, len(out) - REACH)
                near = bytes(out[base:]) + text[at : at + REACH]
                last = len(out) - base - 1
                for k in range(last + 1):
                    if near[k] in b"%\\&" and (m := ESCAPED.match(near, k)) and m.end() > last and (made := _one(m[0])):
                        hi = at + m.end() - last - 1
                        place = self.flat or (starts[base + k], self.place(at, hi)[1] if hi > at else ends[-1])
                        for x in (out, starts, ends, own):
                            del x[base + k :]
                        break
        if not at:
            return None
        append(at, len(text))
        if self.flat is not None:
            return Layer(bytes(out), flat=self.flat, depth=self.depth + 1)
        return Layer(bytes(out), np.array(starts, np.int64), np.array(ends, np.int64), np.frombuffer(bytes(own), bool), depth=self.depth + 1)

    def nested(self):
        """What the layer's escapes, base64 runs and compressed parts hold."""
        if self.depth >= DEEP:
            if (new := self.settled()) is not None:
                yield new
        else:
            for percent, sign in ((True, rb"%"), (False, rb"\\|&#")):
                if re.search(sign, self.text) and (new := self.unescaped(percent)) is not None:
                    yield new
        yield from self.decoded()
        if WIDE.search(self.text):
            yield self.narrow()
        past = 0
        for m in () if self.starts is self.flat is None else PACKED.finditer(self.text):  # not in the text itself
            if m.start() >= past:
                inner, end = unpacked(self.text, m.start())
                past = end or 0
                lo, hi = self.place(m.start(), end or len(self.text))
                yield Layer(inner, flat=(lo, self.close if self.close and past in (0, len(self.text)) else hi))

    def narrow(self) -> Layer:
        """The layer's parts of two-byte characters, the NUL behind or before the other byte, as single bytes; all else is left out."""
        parts, starts, ends = Spool(), [], []
        for m in re.finditer(rb"(?:[^\x00]\x00)+|(?:\x00[^\x00])+", self.text):
            lo, hi = m.span()
            k = int(self.text[lo] == 0)
            for at in range(lo, hi, CHUNK):
                parts.add(self.text[at : min(hi, at + CHUNK)][k::2])
            parts.add(b"\x00")  # a break, which no pattern goes over
            if self.flat is None:
                s, e = (self.starts, self.ends) if self.starts is not None else (np.arange(len(self.text)), np.arange(1, len(self.text) + 1))
                starts += [s[lo:hi:2], s[hi - 1 : hi]]
                ends += [e[lo + 1 : hi : 2], e[hi - 1 : hi]]
        if self.flat is not None:
            return Layer(parts.done(), flat=self.flat, depth=self.depth + 1)
        return Layer(parts.done(), np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(ends or [np.empty(0, np.int64)]), close=self.close, depth=self.depth + 1)

    def decoded(self):
        """A layer for each base64 run and each of the four ways to part its digits, unless it holds nothing to find.

        A code glued to what stands before it starts at some digit, so one of the four ways is its own.
        """
        for m in BASE64.finditer(self.text):
            start, end = m.span()
            where, short = None, end - start < PLAIN
            for skip in range(4):
                data = _digits(self.text, start, end, skip)
                if short and not PACKED.match(data):
                    continue
                if (inner := deflated(data)) and HINT.search(inner):
                    yield Layer(inner, flat=self.place(start, end))
                if not HINT.search(data):
                    continue
                if self.flat is not None:
                    yield Layer(data, flat=self.flat)
                    continue
                if where is None:
                    where = start + np.flatnonzero(_DIGIT[np.frombuffer(self.text[start:end], np.uint8)])
                # a byte lies in known base64 digits
                last = np.arange(1, len(data) + 1)
                lo, hi = where[skip + (last - 1) * 4 // 3], where[np.minimum(skip - (-last * 4 // 3), len(where)) - 1] + 1
                close = self.place(start, end)[1]
                yield Layer(data, lo, hi, close=close) if self.starts is None else Layer(data, self.starts[lo], self.ends[hi - 1], close=close)


def _digits(text, lo: int, hi: int, skip: int) -> bytes | mmap.mmap:
    """The bytes of the base64 digits of text[lo:hi], in either alphabet, behind the first ``skip``."""
    out, rest = Spool(), b""
    for k in range(lo, hi, CHUNK):
        rest += text[k : min(hi, k + CHUNK)].translate(_URL, b" \t\r\n=")[skip if k == lo else 0 :]
        whole = len(rest) // 4 * 4
        out.add(binascii.a2b_base64(rest[:whole]))
        rest = rest[whole:]
    if len(rest) > 1:
        out.add(binascii.a2b_base64(rest + b"=" * (4 - len(rest))))
    return out.done()


def _member(data, at: int, sign: bytes, end: list[int]):
    """The bytes of the compression that starts at ``at`` with ``sign``, a chunk at a time; its end goes to ``end`` if it has one."""
    if sign[0] == 0x1F or sign[0] & 15 == 8:
        made, fed = zlib.decompressobj(31 if sign[0] == 0x1F else 15), b""
        while not made.eof:
            if not fed:
                fed = data[at : at + CHUNK]
                at += len(fed)
                if not fed:
                    yield made.flush()
                    return
            part, fed = made.decompress(fed, CHUNK), made.unconsumed_tail
            yield part
    else:
        made = bz2.BZ2Decompressor() if sign[:1] == b"B" else lzma.LZMADecompressor()
        while not made.eof:
            fed = data[at : at + CHUNK] if made.needs_input else b""
            at += len(fed)
            if made.needs_input and not fed:
                return
            yield made.decompress(fed, CHUNK)
    end.append(at - len(made.unused_data))


def unpacked(data, at: int) -> tuple[bytes | mmap.mmap, int | None]:
    """What the compression at ``at`` and those joined to it hold, as far as they can be read, and the end of the last whole one."""
    out, whole = Spool(), None
    try:
        while m := PACKED.match(data, at):
            end = []
            for part in _member(data, at, m[0], end):
                out.add(part)
            if not end:
                break
            whole = at = end[0]
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        pass
    return out.done(), whole


def deflated(data) -> bytes | mmap.mmap | None:
    """What raw deflate at the start of ``data`` holds, if it comes to its end."""
    kind = data[0] >> 1 & 3 if len(data) else 3
    if kind == 3 or (kind == 0 and data[1:3] != bytes(255 - b for b in data[3:5])):
        return None  # no such block, or a stored one whose lengths disagree
    made, out, at, fed = zlib.decompressobj(-15), Spool(), 0, b""
    try:
        while not made.eof:
            if not fed:
                fed = data[at : at + CHUNK]
                at += len(fed)
                if not fed:
                    return None
            out.add(made.decompress(fed, CHUNK))
            fed = made.unconsumed_tail
    except zlib.error:
        return None
    return out.done() if out.size else None


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans and all spans, sorted, as (start, kind's number, end); decoded layers; layers of more than MAX_LAYER bytes."""
    text = (text or "").encode("latin-1", "replace")
    base = sorted(base_spans(text))
    found, work, layers, large = set(base), [Layer(text)], 0, 0
    met = {(hashlib.sha256(text).digest(), (0, len(text)))}
    while work:
        layer = work.pop()
        for new in layer.nested():
            if not new.text:
                continue
            key = (hashlib.sha256(new.text).digest(), new.place(0, len(new.text)))
            if key in met:
                continue
            met.add(key)
            layers += 1
            large += len(new.text) > MAX_LAYER
            found |= new.spans()
            work.append(new)
    return base, sorted(found), layers, large


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str | None, spans, mask: str = MASK) -> str | None:
    """The text with each stretch that spans cover replaced by the mask."""
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (of base spans), base_sha256, spans (all), n_layers, cut_layers (layers kept in a file)."""

    def start():
        def step(ids, texts):
            rows = []
            for i, t in zip(ids, texts):
                base, spans, layers, cut = scan(t)
                kinds = [k for _, k, _ in base]
                rows.append((i, *map(kinds.count, range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), layers, cut))
            return list(zip(*rows))

        return step

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, cut_layers long"
    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], start, schema)


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each secret in ``text_col`` replaced by a mask; all other columns as they are."""

    def start():
        return lambda texts: [masked(t, scan(t)[1]) for t in texts]

    return arrow_replace(df, text_col, start)
