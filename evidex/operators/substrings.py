"""Which of many strings occur in which of many texts: one scan of the texts, whatever the number of strings.

Each string is known by one of its parts, of 1, 2, 4, ... 32 characters, whichever fits it best: the part with the
least hash. A task hashes every part of its texts, looks the hashes up in a table of bits and then in the sorted parts,
and compares the hash of the whole string where one is met. All hashes are of one polynomial modulo 2^64, so that of
any stretch comes from two sums. What passes leaves the task as the stretch of text itself, and an equi-join with the
strings decides, so that no hash can add a pair, and equal stretches have equal hashes, so that none is lost.

What goes to each task is 33 bytes a string (``AT_ONCE`` strings at most; more are further scans), not the strings.
Long texts are read in windows that overlap by the longest string.

Where only case and blanks are set aside, few texts hold a long string, and :func:`likely` finds these first: of each
string, eight stretches of 32 bytes that begin one after the other are known, so any text with the string has one of them at a
place divisible by eight, and one look for each eight bytes does.

Defined results: null and empty strings occur nowhere, null texts hold nothing; a string that occurs more than once in a
text gives one row for it; repeated rows of either side give repeated rows; comparison is by code points.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import in_blocks, spread

#: Strings whose hashes go to the tasks at once; characters of texts hashed at once; bytes of strings up to which they are broadcast to decide.
AT_ONCE, WINDOW, SENT = 1_000_000, 1 << 17, 16 << 20
#: Lengths of the parts.
PARTS = (1, 2, 4, 8, 16, 32)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Between texts that are hashed together; no string has it.
_BREAK = 0x110000


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE))


class Hashed:
    """Code points whose stretches' hashes are known."""

    def __init__(self, points: np.ndarray):
        self.size = len(points)
        self.base, self.inverse = _powers(max(WINDOW, 1 << (max(1, self.size) - 1).bit_length()))
        own = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((own ^ own >> np.uint64(29)) * self.base[: self.size])])

    def parts(self, n: int) -> np.ndarray:
        """The hashes of all stretches of n."""
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: self.size - n + 1]

    def at(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.inverse[start]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle) to (part, hash, offset, length, whole)."""
    for batch in batches:
        rows = []
        for needle in batch.column(0).to_pylist():
            h = Hashed(points(needle))
            part = next(n for n in reversed(PARTS) if n <= h.size)
            hashes = h.parts(part)
            at = int(hashes.argmin())
            rows.append((part, int(hashes[at].view(np.int64)), at, h.size, int(h.parts(h.size)[0].view(np.int64))))
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["part", "hash", "offset", "length", "whole"])


class Table:
    """The known parts of one length: sorted hashes, and bits that most other hashes miss."""

    def __init__(self, hashes: np.ndarray, offset: np.ndarray, length: np.ndarray, whole: np.ndarray):
        order = hashes.argsort(kind="stable")
        self.hashes, self.offset, self.length, self.whole = hashes[order], offset[order], length[order], whole[order]
        self.shift = np.uint64(64 - min(24, max(16, (64 * len(hashes)).bit_length())))
        self.bits = np.zeros(1 << int(64 - self.shift), bool)
        self.bits[self.hashes >> self.shift] = True

    def met(self, text: Hashed, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, lengths) of stretches whose hash is that of a string."""
        if text.size < part:
            return
        hashes = text.parts(part)
        places = np.flatnonzero(self.bits[hashes >> self.shift])
        low = self.hashes.searchsorted(hashes[places])
        many = self.hashes.searchsorted(hashes[places], "right") - low
        places, low, many = places[many > 0], low[many > 0], many[many > 0]
        for at in range(0, len(places), 4096):
            n = many[at : at + 4096]
            # a part that many strings share meets them a slice at a time
            for step in range(0, int(n.max()), 256):
                k = np.clip(n - step, 0, 256)
                of = np.repeat(np.arange(len(k)), k)
                string = low[at : at + 4096][of] + step + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
                start = places[at : at + 4096][of] - self.offset[string]
                good = (start >= 0) & (start + self.length[string] <= text.size)
                start, string = start[good], string[good]
                good = text.at(start, self.length[string]) == self.whole[string]
                yield start[good], self.length[string][good]


def _seek(known: dict[int, Table], longest: int, schema: pa.Schema, without: bytes = b""):
    """(keys..., text) to (keys..., needle): the stretches met of texts that the bytes ``without`` are taken from."""

    def found(texts: list[str]) -> Iterator[tuple[int, str]]:
        """(which text, stretch) of some texts that are hashed together."""
        codes = [points(t) for t in texts]
        begins = np.cumsum([0, *(len(c) + 1 for c in codes)])
        stop = np.array([_BREAK], np.uint32)
        whole = Hashed(np.concatenate([x for c in codes for x in (c, stop)]))
        seen = set()
        for part, table in known.items():
            for starts, lengths in table.met(whole, part):
                owner = begins.searchsorted(starts, "right") - 1
                for i, s, n in zip(owner.tolist(), (starts - begins[owner]).tolist(), lengths.tolist()):
                    if s + n <= len(texts[i]) and (x := (i, texts[i][s : s + n])) not in seen:
                        seen.add(x)
                        yield x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(WINDOW, 4 * longest)
        for batch in batches:
            rows, needles, some, owners, size = [], [], [], [], 0

            def settle():
                nonlocal some, owners, size
                for i, needle in found(some) if some else ():
                    rows.append(owners[i])
                    needles.append(needle)
                some, owners, size = [], [], 0

            texts = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                text = raw.to_pybytes().translate(None, without).decode() if raw else ""
                if not text:
                    continue
                for at in range(0, max(1, len(text) - longest + 1), step - longest + 1):
                    piece = text[at : at + step]
                    if size + len(piece) > step:
                        settle()
                    some.append(piece)
                    owners.append(i)
                    size += len(piece) + 1
            settle()
            pairs = list(dict.fromkeys(zip(rows, needles)))  # windows overlap
            which = pa.array([r for r, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(which) for c in batch.columns[:-1]), pa.array([n for _, n in pairs], pa.string())], names=schema.names)

    return run


#: ASCII in lower case; what :func:`likely` reads texts without, besides blanks: all that is not ASCII.
_LOWER, _BEYOND = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256)), bytes(range(128, 256))
#: The two characters beyond ASCII whose lower case has a letter of a-z.
_TO_ASCII = tuple(c.encode() for c in "\u0130\u212a")
#: Bytes of a stretch that is looked for, from how many bytes on a string has eight of them, and bytes looked through at once.
STRETCH, LEAST, AT_A_TIME = 32, 39, 1 << 18
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _stretches(raw: bytes) -> np.ndarray:
    """Hashes of the stretches of ``STRETCH`` bytes that begin at the places divisible by eight."""
    eight = np.frombuffer(raw, "<u8", len(raw) // 8)
    n = max(0, len(eight) - 3)
    out = eight[:n] * _MIX[0]
    for i in (1, 2, 3):
        out ^= out >> np.uint64(29)
        out += eight[i : i + n] * _MIX[i]
    return out * _MIX[0]


def _eight_of(batches: Iterator[pa.RecordBatch], without: bytes) -> Iterator[pa.RecordBatch]:
    """(needle) to (hash): of each string, those of eight stretches that begin one after the other, the least hash of all decides where; null of a string that is too short for eight."""
    for batch in batches:
        out = []
        for needle in batch.column(0).to_pylist():
            raw = needle.encode("utf-8", "surrogatepass").translate(_LOWER, _BEYOND + without)
            if len(raw) < LEAST:
                out.append(pa.nulls(1, pa.int64()))
                continue
            every = np.empty(len(raw) - STRETCH + 1, np.uint64)
            for i in range(8):
                every[i::8] = _stretches(raw[i:])
            at = int(every[: len(every) - 7].argmin())
            out.append(pa.array(every[at : at + 8].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(out) if out else pa.nulls(0, pa.int64())], names=["hash"])


def _sift(hashes: np.ndarray, without: bytes):
    """(keys..., text) to those rows whose text has a stretch of these hashes, or a character whose lower case is one of ASCII."""
    hashes = np.unique(hashes.view(np.uint64))
    shift = np.uint64(64 - min(24, max(16, (64 * len(hashes)).bit_length())))
    bits = np.zeros(1 << int(64 - shift), bool)
    bits[hashes >> shift] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, good = batch.column(batch.num_columns - 1), np.zeros(batch.num_rows, bool)
            some, owners, size = [], [], 0

            def settle():
                met = _stretches(b"".join(some))
                places = np.flatnonzero(bits[met >> shift])
                places = places[hashes[np.minimum(hashes.searchsorted(met[places]), len(hashes) - 1)] == met[places]]
                # a stretch over the end of a text finds its first one for nothing
                good[np.array(owners)[np.cumsum([len(x) for x in some]).searchsorted(places * 8, "right")]] = True

            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                if not raw:
                    continue
                raw = raw.to_pybytes()
                if not raw.isascii() and any(c in raw for c in _TO_ASCII):
                    good[i] = True
                    continue
                some.append(raw.translate(_LOWER, _BEYOND + without))
                owners.append(i)
                size += len(some[-1])
                if size > AT_A_TIME:
                    settle()
                    some, owners, size = [], [], 0
            if some:
                settle()
            yield batch.filter(pa.array(good))

    return run


def likely(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", without: str = "") -> DataFrame:
    """Those of ``texts`` that could hold a string once they are in lower case and without ``without``, and few others; strings are given that way.

    All texts, if a string has less than ``LEAST`` bytes of ASCII or if strings are more than ``AT_ONCE``.
    """
    whole = needles.filter(F.length(needle) > 0).select(F.col(needle).alias("needle")).distinct()
    blanks = without.encode("ascii")
    hashes = whole.limit(AT_ONCE + 1).mapInArrow(lambda batches: _eight_of(batches, blanks), "hash long").toArrow()["hash"]  # 64 bytes a string
    if not len(hashes) or hashes.null_count or len(hashes) > 8 * AT_ONCE:
        return texts
    sent = texts.sparkSession.sparkContext.broadcast(hashes.to_numpy())
    columns = [*(c for c in texts.columns if c != text), text]
    return spread(texts.select(columns)).mapInArrow(lambda batches: _sift(sent.value, blanks)(batches), texts.select(columns).schema).select(texts.columns)


def occurrences(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", without: str = "") -> DataFrame:
    """The other columns of ``needles`` and of ``texts``, for each string that a text holds; the two have no column in common.

    ``without``: characters of ASCII that texts are read without, as if they were not there.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [c for c in texts.columns if c != text]
    schema = T.StructType([*(texts.schema[c] for c in keys), T.StructField("_stretch", T.StringType())])
    held = texts.select(*keys, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    strings = needles.filter(F.length(needle) > 0)
    whole = strings.select(F.col(needle).alias("needle")).distinct()
    found = []
    for block in in_blocks(whole, "needle", AT_ONCE):
        digest = block.mapInArrow(_known, "part byte, hash long, offset long, length long, whole long").toArrow()  # 33 bytes a string
        if not digest.num_rows:
            continue
        part, hashes, offset, length, full = (digest.column(i).to_numpy() for i in range(5))
        known = {int(n): Table(hashes[part == n].view(np.uint64), offset[part == n], length[part == n], full[part == n].view(np.uint64)) for n in np.unique(part)}
        sent = texts.sparkSession.sparkContext.broadcast(known)
        longest = int(length.max())
        arrow = to_arrow_schema(schema)

        def run(batches, sent=sent, longest=longest):
            return _seek(sent.value, longest, arrow, without.encode("ascii"))(batches)

        found.append(spread(held).mapInArrow(run, schema))
    if not found:
        shape = T.StructType([*(f for f in needles.schema if f.name != needle), *(texts.schema[c] for c in keys)])
        return texts.sparkSession.createDataFrame([], shape)  # no string, no row
    met = functools.reduce(DataFrame.unionByName, found)
    size = strings.agg(F.sum(F.octet_length(needle) + 64)).first()[0] or 0
    strings = F.broadcast(strings) if size <= SENT else strings
    return met.join(strings, F.col("_stretch") == F.col(needle)).select(*[c for c in needles.columns if c != needle], *keys)
