"""Product codes of vectors: one codebook for each of a vector's parts, learned in whole numbers.

Components become integers floor(scale * x), and a vector is cut into equal parts. Equal parts of a position
are one weighted row: rows are counted before they are shuffled, so a vector that a third of all rows repeat is
one row a task. Lloyd's rounds run over these rows: each task assigns its own to the nearest entries and returns
one sum an entry, the entries themselves (parts * entries, whatever the input) go with the tasks. At the end the
rows' codes and errors are joined back to the vectors: parts that more than a thousandth of all vectors share are
at most a thousand a position, and are broadcast; all others meet in a plain sort-merge join.

Distances, sums and means are exact: products of matrices in double precision only where every term is below
2^52, Python's integers elsewhere.

Defined results: rows whose vector is null or holds a null or non-finite component go. Codebooks start from the
smallest ids, a null id last; of rows that share one, the one whose parts' bytes come first; fewer ids make fewer
entries. The dimension is that of the smallest id whose length is a positive multiple of the number of parts;
vectors of another length stay with a null code and error. Integers are held within 2^62 either way, and an error
or a sum of errors beyond 64 bits is the largest long. Repeated rows each keep their place; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release
from .topk import usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A part that more than one in so many vectors have is joined by broadcast; a position has no more such parts than this.
SHARED = 1000
#: The most groups of labels whose sums are sent to every task; more are joined by a shuffle.
LABELS = 100_000
LEAST, MOST = -(1 << 62), 1 << 62
LONG = (1 << 63) - 1


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of integers as bytes, each row in 2, 4 or 8 bytes a component: the lengths and all bytes."""
    low, high = x.min(1), x.max(1)
    width = np.where((low >= -(1 << 15)) & (high < 1 << 15), 2, np.where((low >= -(1 << 31)) & (high < 1 << 31), 4, 8))
    length = width * x.shape[1]
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for w in (2, 4, 8):
        rows = np.flatnonzero(width == w)
        if len(rows):
            own = x[rows].astype(f"<i{w}").view(np.uint8).reshape(len(rows), -1)
            out[(ends - length)[rows][:, None] + np.arange(own.shape[1])] = own
    return length, out


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """The integers of a column of :func:`packed` rows of ``size`` components."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, length = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.diff(offsets)
    out = np.empty((len(column), size), np.int64)
    for w in (2, 4, 8):
        rows = np.flatnonzero(length == w * size)
        if len(rows):
            out[rows] = np.ascontiguousarray(data[offsets[rows][:, None] + np.arange(w * size)]).view(f"<i{w}")
    return out


def _binary(length: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _cut(scale: int, parts: int):
    """(row, id, label, v) to (row, id, label, d, parts), the parts of a vector whose length they do not divide being null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            offsets = vectors.offsets.to_numpy(zero_copy_only=False)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            d = np.diff(offsets)
            for size in np.unique(d):
                rows = np.flatnonzero(d == size)
                some = batch.take(pa.array(rows)).select([0, 1, 2])
                if size and size % parts == 0:
                    with np.errstate(over="ignore"):
                        x = np.floor(flat[offsets[rows][:, None] + np.arange(size)] * scale)
                    x = np.where(x >= MOST, MOST, np.where(x <= LEAST, LEAST, x)).astype(np.int64)
                    cut = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * parts, pa.int32()), _binary(*packed(x.reshape(-1, size // parts))))
                else:
                    cut = pa.nulls(len(rows), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(rows), size), pa.int32()), cut], names=["row", "id", "label", "d", "parts"])

    return run


def nearest(x: np.ndarray, pos: np.ndarray, books: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (its position's codebook, ties to the lower), and the squared distance."""
    n, size = x.shape
    most = max(int(np.abs(x).max(initial=0)), max(abs(c) for book in books for entry in book for c in entry))
    exact = size * (2 * most) ** 2 < 1 << 52
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64 if exact else object)
    for p, book in enumerate(books):
        rows = np.flatnonzero(pos == p)
        if exact:
            own, c = x[rows].astype(np.float64), np.array(book, np.float64)
            far = (c * c).sum(1) - 2 * (own @ c.T)
            code[rows] = k = far.argmin(1)
            error[rows] = ((own * own).sum(1) + far[np.arange(len(rows)), k]).astype(np.int64)
        else:
            for i in rows:
                own = x[i].tolist()
                error[i], code[i] = min((sum((a - b) ** 2 for a, b in zip(own, entry)), k) for k, entry in enumerate(book))
    return code, error


def _summed(books: list[list[list[int]]], size: int):
    """(pos, part, n) to (pos, k, n, s): each entry's number of vectors and sums of their components, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        entries = max(map(len, books))
        for batch in batches:
            x, pos, n = unpacked(batch.column(1), size), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            slot = pos * entries + nearest(x, pos, books)[0]
            small = int(np.abs(x).max(initial=0)) * int(n.sum()) < LONG
            for s in np.unique(slot):
                own = slot == s
                sums = (x[own] * n[own][:, None]).sum(0).tolist() if small else [sum(map(int.__mul__, c, n[own].tolist())) for c in x[own].T.tolist()]
                held[int(s)] = [a + b for a, b in zip(held.get(int(s), [0] * (size + 1)), [int(n[own].sum()), *sums])]
        if held:
            whole = pa.decimal128(38, 0)
            columns = [pa.array([s // entries for s in held], pa.int32()), pa.array([s % entries for s in held], pa.int32())]
            columns.append(pa.array([[Decimal(v) for v in row] for row in held.values()], pa.list_(whole)))
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "k", "s"])

    return run


def _coded(books: list[list[list[int]]], size: int):
    """(pos, part) to (pos, part, k, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(unpacked(batch.column(1), size), batch.column(0).to_numpy(), books)
            columns = [*batch.columns, pa.array(code.astype(np.int32)), pa.array([min(int(e), LONG) for e in error] if error.dtype == object else error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "part", "k", "error"])

    return run


def learned(distinct: DataFrame, books: list[list[list[int]]], size: int, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks after ``rounds`` of weighted Lloyd over (pos, part, n); an entry that no part is nearest to stays as it is."""
    for _ in range(rounds):
        sums = distinct.mapInArrow(_summed(books, size), "pos int, k int, s array<decimal(38,0)>").groupBy("pos", "k")
        books = [[list(entry) for entry in book] for book in books]
        for r in sums.agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(size + 1)]).collect():  # as many as entries
            books[r["pos"]][r["k"]] = [int(r[f"s{j}"]) // int(r["s0"]) for j in range(1, size + 1)]
    return books


def coded(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    vec = F.col(vec_col)
    vec = vec if df.schema[vec_col].dataType.simpleString() == "array<float>" else vec.cast("array<double>")
    label = df.schema[label_col].dataType.simpleString()
    kept = df.filter(usable(F.col(vec_col))).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("v"))
    rows = keep(kept.mapInArrow(_cut(scale, parts), f"row long, id long, label {label}, d int, parts array<binary>"), "vector-parts")
    first = rows.filter("parts is not null").agg(F.min(F.struct(F.col("id").isNull(), "id", "d")).alias("x"), F.count("*").alias("n")).first()
    shape, n = first["x"], first["n"]
    if shape is None:
        books, sides = [[] for _ in range(parts)], rows.select("row", "id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        size = shape["d"] // parts
        fit = rows.filter(F.col("d") == shape["d"])
        ids = F.broadcast(fit.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).select(F.col("id").alias("first_id")))  # that many rows
        starts = fit.join(ids, F.col("id").eqNullSafe(F.col("first_id")), "left_semi").groupBy("id").agg(F.min("parts").alias("parts")).collect()
        starts = [unpacked(pa.array([bytes(p) for p in r["parts"]], pa.binary()), size).tolist() for r in sorted(starts, key=lambda r: (r["id"] is None, r["id"]))]
        each = fit.select("row", "id", "label", F.posexplode("parts").alias("pos", "part"))
        distinct = keep(each.groupBy("pos", "part").agg(F.count("*").alias("n")), "distinct-parts")
        books = learned(distinct, [[start[p] for start in starts] for p in range(parts)], size, rounds)
        codes = [distinct.filter(f"{'' if shared else 'not '}n * {SHARED} > {n}").select("pos", "part").mapInArrow(_coded(books, size), "pos int, part binary, k int, error long") for shared in (True, False)]
        met = each.join(F.broadcast(codes[0]), ["pos", "part"]).unionByName(each.join(F.broadcast(codes[0].select("pos", "part")), ["pos", "part"], "left_anti").join(codes[1], ["pos", "part"]))
        digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda x: F.lpad(F.lower(F.hex(x["k"])), 2, "0")), "")  # a vector's parts
        sides = met.groupBy("row", "id", "label").agg(digits.alias("code"), _held(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
        odd = rows.filter(F.col("d") != shape["d"]).select("row", "id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        sides = sides.unionByName(odd)
    out = keep(sides.select("id", "label", "code", "error"), "vector-codes")
    release(rows)
    if shape is not None:
        release(distinct)
    sums = out.groupBy(F.col("label").alias("of")).agg(_held(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    sums = F.broadcast(sums) if out.agg(F.approx_count_distinct("label")).first()[0] <= LABELS else sums
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return out.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _held(total: F.Column) -> F.Column:
    """A sum as a long, the largest where it is beyond."""
    return F.when(total > F.lit(LONG), F.lit(LONG)).otherwise(total.cast("long"))
