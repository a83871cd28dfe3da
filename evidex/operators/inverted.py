"""Vector search by an inverted file: lists of vectors around centroids, of which a query looks into the nearest.

Centroids are fitted by spherical k-means to at most ``SAMPLE`` vectors, those whose ids have the least hashes; every
vector is in a list. With as many probes as lists the search is exact; :func:`recall` says what fewer cost. A list that
holds a large part of all vectors is split into blocks, which all queries of the list meet.

Defined results: a vector that is null, has a null or no finite length, or another dimension than the first of the
sample, is in no list; queries alike. A vector without direction (all zeros) has no score, as in the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import keep, spread
from .retrieval import VECTOR_BLOCK, cells, ranked, whole_vectors

SAMPLE, LISTS, ROUNDS = 20_000, 64, 8


@dataclass
class InvertedFile:
    """lists: (chunk, vec, d, list), kept; sizes: list -> vectors in it."""

    lists: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of directions: the first ones lie evenly in the sample, an empty list keeps its own."""
    x = _unit(sample)
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where((sums * sums).sum(1, keepdims=True) > 0, _unit(sums), centroids)
    return centroids


def _nearest(centroids: np.ndarray, probes: int, names: list[str]):
    """Adds to (key, vec, d) the lists whose centroids are nearest, as one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, centroids.shape[1])
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], names=[*names, "list"])

    return run


def _usable(df: DataFrame, key: str, dimension: int) -> DataFrame:
    finite = F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return whole_vectors(df, key).filter((F.col("d") == dimension) & finite)


def built(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> InvertedFile:
    """The inverted file of (chunk, vec)."""
    some = whole_vectors(vectors, "chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(sample).select("vec", "d").collect()  # at most ``sample`` vectors
    d = some[0]["d"] if some else 0
    rows = np.array([r["vec"] for r in some if r["d"] == d], float).reshape(-1, max(d, 1))
    rows = rows[np.isfinite(rows).all(1)]
    if not len(rows):
        return InvertedFile(whole_vectors(vectors, "chunk").limit(0).withColumn("list", F.lit(0)), np.zeros((0, max(d, 1))), {})
    centroids = fitted(rows, lists)
    own = spread(_usable(vectors, "chunk", d))
    kind = vectors.schema["chunk"].dataType.simpleString()
    held = own.mapInArrow(_nearest(centroids, 1, ["chunk", "vec", "d"]), f"chunk {kind}, vec {vectors.schema['vec'].dataType.simpleString()}, d int, list int")
    held = keep(held, "inverted", lasting=True)
    return InvertedFile(held, centroids, {r["list"]: r["count"] for r in held.groupBy("list").count().collect()})  # one row a list


def search(index: InvertedFile, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query, chunk, score, rank): the k best of the ``probes`` lists nearest to each query (query, vec)."""
    kind, vec = queries.schema["query"].dataType.simpleString(), queries.schema["vec"].dataType.simpleString()
    asked = spread(_usable(queries, "query", index.centroids.shape[1]))
    wanted = asked.mapInArrow(_nearest(index.centroids, probes, ["query", "vec", "d"]), f"query {kind}, vec {vec}, d int, list int")
    parts = {n: -(-size // VECTOR_BLOCK) for n, size in index.sizes.items()}
    of = F.create_map(*[F.lit(x) for pair in (parts or {-1: 1}).items() for x in pair])
    left = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(of, F.col("list")), F.lit(1)) - 1)))
    right = index.lists.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(of, F.col("list"))).cast("int"))
    return ranked(cells(left, right, ["list", "part"], k).withColumn("score", F.round("score", 6)), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact search's hits that were found."""
    met = exact.select("query", "chunk").join(found.select("query", "chunk").withColumn("_met", F.lit(1)), ["query", "chunk"], "left")
    return float(met.agg(F.avg(F.coalesce("_met", F.lit(0)))).first()[0] or 1.0)
