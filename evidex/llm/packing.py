"""Packing documents into sequences by patterns fitted with non-negative least squares.

The histogram of piece lengths (at most ``LIMIT`` counts, whatever the input) goes to the driver. There,
patterns of few documents are enumerated over coarse bins of length, their repeat counts are fitted to
the histogram by non-negative least squares and rounded down, and the plan is written out in exact
lengths: the last place of a pattern takes the longest length that still fits. What is left is packed
longest first, each sequence being filled with the longest lengths that fit. The same is done with smaller parts of
the fitted counts, and the plan with the fewest sequences is taken. The plan is a list of ranges
(length, from, to) -> (sequence, offset) whose size is bounded by ``LIMIT``, not by the input.

Pieces are numbered within their length by buckets of ids, so that a length that a third of all rows
share is not one task's work, and find their range by a join with the plan.

Defined results: a null text is empty and is one piece, the end token; rows without an id, repeated rows
and ties are packed as rows of their own; an empty table gives an empty table; other columns are not read.
Only documents longer than a sequence are cut; the first piece is the shorter one, the others are full.
"""

from __future__ import annotations

import base64
import itertools
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, keep, per_process

LIMIT = 2048
END = 0
#: Bins over the lengths, and documents in a pattern at most.
BINS, DEPTH = 64, 4
#: Tokens that a sequence of a pattern may leave free; documents that leave more wait for the best fit.
SLACK = 1
#: Parts of the fitted counts that are tried.
SHARES = (1, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01)
#: Pieces of one length in a bucket, about.
BUCKET = 200_000


def ranks(name: str) -> dict[bytes, int]:
    with open(name, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def added(name: str) -> dict[str, int]:
    """The tokens that the JSON file beside the rank file adds to its vocabulary."""
    with open(f"{name.removesuffix('.tiktoken')}.json", encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by the active set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[k] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Bins, largest first, of at most ``depth`` documents that fill a sequence of ``bins`` bins."""
    out = []

    def grow(left: int, most: int, got: tuple):
        if left == 0:
            out.append(got)
        elif len(got) < depth:
            for k in range(min(left, most), 0, -1):
                if k * (depth - len(got)) < left:
                    break
                grow(left - k, k, (*got, k))

    grow(bins, bins, ())
    return out


class Stock:
    """How many pieces of each length are left, and the longest length with some that is not above a bound."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)

    def longest(self, most: int, least: int = 1, held: dict | None = None) -> int:
        for k in np.nonzero(self.left[least : most + 1])[0][::-1]:
            if self.left[k + least] > (held or {}).get(int(k) + least, 0):
                return int(k) + least
        return 0


def plan(counts: np.ndarray, limit: int = LIMIT, bins: int = BINS, depth: int = DEPTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, first number, after the last, first sequence, offset), and the number of sequences.

    ``counts[k]``: pieces of length k, up to the limit. The fitted counts are tried whole and in parts, since what is
    left of many lengths packs better among more pieces; of the plans, the one with the fewest sequences is returned.
    """
    width = limit // bins
    shapes = patterns(bins, depth)
    a = np.zeros((bins, len(shapes)))
    for j, shape in enumerate(shapes):
        for k in shape:
            a[k - 1, j] += 1
    short = counts[:limit]  # a full piece is a sequence of its own
    fitted = nnls(a, np.array([*(short[k * width + 1 : (k + 1) * width + 1].sum() for k in range(bins))], float))
    plans = (written(counts, shapes, np.floor(share * fitted).astype(np.int64), limit, width) for share in SHARES)
    return min(plans, key=lambda p: p[1])


def written(counts: np.ndarray, shapes: list[tuple[int, ...]], repeats: np.ndarray, limit: int, width: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """A plan in exact lengths: each shape as often as ``repeats`` says and lengths allow, then the best fit for the rest."""
    stock, out, sequences = Stock(counts), [], 0

    def emit(lengths: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for k in lengths:
            # the same length may stand in a pattern more than once: each place has its own range
            out.append((k, int(stock.used[k]), int(stock.used[k]) + times, sequences, offset))
            stock.used[k] += times
            stock.left[k] -= times
            offset += k
        sequences += times

    def times(lengths: list[int], most: int) -> int:
        return min([most, *(int(stock.left[k]) // lengths.count(k) for k in set(lengths))])

    if stock.left[limit]:
        emit([limit], int(stock.left[limit]))
    for j in sorted(np.nonzero(repeats)[0], key=lambda j: shapes[j], reverse=True):
        todo = int(repeats[j])
        while todo > 0:
            lengths, room, held = [], limit, {}
            for place, k in enumerate(shapes[j]):
                last = place == len(shapes[j]) - 1
                top = room if last else min(room, k * width)
                got = stock.longest(top, max(1, top - SLACK if last else (k - 1) * width + 1), held)
                if not got:
                    break
                lengths.append(got)
                held[got] = held.get(got, 0) + 1
                room -= got
            if len(lengths) < len(shapes[j]):
                break
            n = times(lengths, todo)
            emit(lengths, n)
            todo -= n
    while first := stock.longest(limit):
        lengths, room, held = [first], limit - first, {first: 1}
        while room and (got := stock.longest(room, 1, held)):
            lengths.append(got)
            held[got] = held.get(got, 0) + 1
            room -= got
        emit(lengths, max(1, times(lengths, int(stock.left[first]))))
    return out, sequences


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32.

    ``tokenizer``: the rank file of the byte-level vocabulary, whose ids are those of the JSON file beside
    it, added tokens included; the tests hold both libraries' ids against each other.
    """

    def start():
        import public_tokenizers
        import tiktoken

        def make():
            return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(tokenizer), special_tokens=added(tokenizer))

        coder = per_process(("pieces", tokenizer), make)

        def step(ids, texts):
            rows = []
            for i, t in zip(ids, texts):
                n = np.array([*coder.encode(t or "", allowed_special="all"), end], "<u4")
                cuts = [0, *range(len(n) % limit or limit, len(n), limit), len(n)]
                for k, (s, e) in enumerate(itertools.pairwise(cuts)):
                    rows.append((i, k, s, e - s, zlib.crc32(n[s:e])))
            return list(zip(*rows))

        return step

    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], start, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32, part), a kept table, with sequence_id and offset.

    part: any number that tells rows apart which are else the same, so that many of them are dealt to many buckets.
    """
    spark = cut.sparkSession
    seen = cut.groupBy("length").count().collect()  # at most ``limit`` rows
    counts = np.zeros(limit + 1, np.int64)
    for r in seen:
        counts[r["length"]] = r["count"]
    ranges, _ = plan(counts, limit)
    lo = spark.createDataFrame(ranges or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, first long, offset long")
    buckets = max(16, int(counts.max() // BUCKET) + 1)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "part"), F.lit(buckets)).cast("int"))
    of = Window.partitionBy("length", "bucket")
    numbered = cut.withColumn("n", F.row_number().over(of.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    sizes = cut.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = numbered.join(sizes, ["length", "bucket"]).withColumn("n", F.col("n") + F.col("base"))
    # the plan has at most a few times ``limit`` rows, whatever the input
    fits = (numbered["length"] == lo["length"]) & (numbered["n"] >= lo["lo"]) & (numbered["n"] < lo["hi"])
    return numbered.join(F.broadcast(lo), fits).select(
        "doc_id", "piece", "start", numbered["length"], "ids_crc32", (F.col("first") + F.col("n") - F.col("lo")).alias("sequence_id"), "offset"
    )


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    cut = pieces(df, tokenizer, id_col, text_col, limit).withColumn("part", (F.monotonically_increasing_id() % 1024).cast("short"))
    return place(keep(cut, "pieces"), limit)
