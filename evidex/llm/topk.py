"""Exact top-k by inner product, with bounds from segment means and deviations, coarse to fine.

A vector's segments have means and deviations (norms of what remains). By the inequality of Cauchy and
Schwarz, the inner product of two vectors is at most the sum over segments of width * mean * mean +
deviation * deviation; as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, that is a lower bound of their distance.
Exact products of the candidates with the best coarse bounds give a first k-th best score; candidates whose
bound is below it go, with one segment, then four, then sixteen, of survivors only, and each level's best
bounds raise the score to beat; what is left gets exact integer products.

The query set is stated (ids divisible by a number), so its blocks meet all blocks of candidates: a cell
holds at most one block of each, whatever the input, and returns k rows a query, which a window merges.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part; a vector meets only those of its own dimension; ties go to the smaller id, and repeated
candidate rows each keep their place; a query's own id is no candidate of it; repeated query rows give
one result; products are exact however large the components, and one that a long cannot hold keeps its rank
and is returned as the nearest long; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism

SCALE, K, EVERY = 1024, 10, 100
LEVELS = (1, 4, 16)
QUERIES, CANDIDATES, AT_ONCE = 1024, 16_384, 64


def usable(vec) -> F.Column:
    def finite(x):
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(finite(x), F.lit(False)))


class Segments:
    """Means (times the roots of widths) and deviations of a block's segments, at each level."""

    def __init__(self, x: np.ndarray):
        self.levels = []
        d = x.shape[1]
        self.norms = np.sqrt((x * x).sum(1))
        for n in LEVELS:
            if n > d:
                break
            cuts = np.linspace(0, d, n + 1).astype(int)
            widths = np.diff(cuts)
            means = np.add.reduceat(x, cuts[:-1], axis=1) / widths
            rest = np.add.reduceat((x - np.repeat(means, widths, axis=1)) ** 2, cuts[:-1], axis=1)
            self.levels.append(np.hstack([means * np.sqrt(widths), np.sqrt(rest)]))

    def bounds(self, level: int, queries: Segments, which, rows=slice(None)) -> np.ndarray:
        """Upper bounds of the products of some queries with rows, raised by what rounding can take."""
        return queries.levels[level][which] @ self.levels[level][rows].T + 1e-9 * queries.norms[which][..., None] * self.norms[rows] + 1e-6


class Rows:
    """A block's ids and whole components: 64-bit integers, or Python's own where products could leave 64 bits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids = ids
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(x * SCALE)
            self.segments = Segments(v)
        self.most = float(np.abs(v).max(initial=0.0))
        self.x, self.v = x, v.astype(np.int64) if self.most < 2.0**62 else None

    def products(self, rows, query: list[int] | np.ndarray, small: bool) -> np.ndarray:
        if small:
            return self.v[rows] @ query
        return np.array([sum(map(int.__mul__, whole(x), query)) for x in self.x[rows]], object)


def whole(x: np.ndarray) -> list[int]:
    """floor(SCALE * x), exactly."""
    return [math.floor(SCALE * y) if abs(y) < 2.0**52 else SCALE * int(y) for y in x.tolist()]


def cell_top(queries: Rows, rows: Rows, k: int = K, met: dict | None = None):
    """(query id, candidate id, score) of each query's k best candidates; integers throughout.

    ``met`` counts the candidates whose bounds were taken at each level, and whose products were.
    """
    out, segments = [], rows.segments
    last, met = len(segments.levels) - 1, {} if met is None else met
    small = queries.most * rows.most * max(1, rows.x.shape[1]) < 2.0**62
    for at in range(0, len(queries.ids), AT_ONCE):
        with np.errstate(over="ignore", invalid="ignore"):
            coarse = segments.bounds(0, queries.segments, np.s_[at : at + AT_ONCE])
        for i in range(at, min(at + AT_ONCE, len(queries.ids))):
            left = np.flatnonzero(rows.ids != queries.ids[i])
            if not len(left):
                continue
            query = queries.v[i] if small else whole(queries.x[i])
            bound, floor = coarse[i - at][left], None
            for level in range(last + 1):
                if level:
                    with np.errstate(over="ignore", invalid="ignore"):
                        bound = segments.bounds(level, queries.segments, i, left)
                met[level] = met.get(level, 0) + len(left)
                # the best bounds' products: the k-th best score is no less than the least of them
                first = left[np.argpartition(-bound, min(k, len(left)) - 1)[:k]]
                least = min(rows.products(first, query, small))
                floor = least if floor is None else max(floor, least)
                if len(left) <= k or (len(first) < k):
                    break
                # a bound that overflowed tells nothing
                left = left[~(bound < floor)]
            met["products"] = met.get("products", 0) + len(left)
            score = rows.products(left, query, small)
            best = np.lexsort((rows.ids[left], -score)) if small else np.array(sorted(range(len(left)), key=lambda j: (-score[j], rows.ids[left[j]])))
            best = best[:k]
            out.append((np.full(len(best), queries.ids[i]), rows.ids[left[best]], score[best]))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*out) if out else ([], [], []))]


def _beyond(score: int) -> tuple[list[int], int]:
    """What orders a score that a long cannot hold, above or below all others, and the nearest long."""
    held = min(max(score, -(1 << 63)), (1 << 63) - 1)
    return [0] if held == score else [1 if score > 0 else -1, *(score >> 62 * j & ((1 << 62) - 1) for j in reversed(range(40)))], held


def _search(batches):
    def block(side):
        ids = side.field("ids").flatten().to_numpy(zero_copy_only=False)
        flat = side.field("flat").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        return Rows(ids, flat if flat.shape[1] else np.zeros((len(ids), 1)))

    for batch in batches:
        for i in range(batch.num_rows):
            sides = batch.column(0).slice(i, 1).flatten()
            is_query = sides.field("query").to_pylist()
            if sorted(is_query) != [False, True]:
                continue  # no query of this dimension, or nothing to compare it with
            found = cell_top(block(sides.slice(is_query.index(True), 1)), block(sides.slice(is_query.index(False), 1)))
            beyond = [[0]] * len(found[2])
            if found[2].dtype == object:
                beyond, found[2] = zip(*map(_beyond, found[2])) if len(found[2]) else ([], found[2])
            arrays = [*(pa.array(x, pa.int64()) for x in found), pa.array(list(beyond), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score", "beyond"])


def top_k(df: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    vec = F.col(vec_col)
    # single precision is shuffled as it is
    kept = vec if df.schema[vec_col].dataType.simpleString() == "array<float>" else vec.cast("array<double>")
    rows = df.filter(usable(vec) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), kept.alias("v"), F.size(vec).alias("d"))
    asked = rows.filter(F.col("id") % every == 0)
    n, nq = (int(x) for x in rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first())
    nc, nb = max(1, math.ceil(n / CANDIDATES), min(2 * parallelism(df.sparkSession), n // 2048)), max(1, math.ceil(nq / QUERIES))

    def blocks(part: DataFrame, key, count: int, others: int, query: bool) -> DataFrame:
        mine = part.withColumn("b", F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))
        packed = mine.groupBy("d", "b").agg(F.collect_list(F.struct("id", "v")).alias("x"))
        side = F.struct(F.lit(query).alias("query"), F.col("x.id").alias("ids"), F.flatten("x.v").alias("flat"))
        other = F.sequence(F.lit(0), F.lit(others - 1))
        cell = F.transform(other, lambda o: (o * count + F.col("b")) if not query else (F.col("b") * others + o))
        return packed.select("d", F.explode(cell).alias("cell"), side.alias("side"))

    # a query id asks once, however many rows carry it; as candidates, rows that share an id are dealt to all blocks
    asked = asked.dropDuplicates(["id", "v"])
    both = blocks(rows, F.monotonically_increasing_id(), nc, nb, False).unionByName(blocks(asked, F.col("id"), nb, nc, True))
    cells = both.repartition(min(2 * nc * nb, 20_000), "d", "cell").groupBy("d", "cell").agg(F.collect_list("side").alias("sides")).select("sides")
    found = cells.mapInArrow(_search, "query_id long, vec_id long, score long, beyond array<long>")
    best = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
