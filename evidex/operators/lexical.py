"""BM25 over a store of chunks, by an index that grows with the store's commits.

An update reads what was committed since the last one: the new rows become one segment of postings, the rows that were
hidden since become dead keys, and the statistics of terms (documents with each term), rows and lengths are added to and
subtracted from. So a hundredth of new files costs a hundredth of an index, and scores are those of an index made anew.

A posting list is blocks of up to ``BLOCK`` postings, best first, in order of a hash of the term, each with the greatest
frequency and the least length in it, which bound what a block can add to a score whatever the corpus's mean length has
become. A query first scores the first block of each of its terms; the k-th best of these sums is a score to beat, and of
all further blocks only those are opened that could still reach it together with the best of the other terms.

The counts of each chunk's terms are kept as well, a row a chunk. Questions whose posting lists are together longer than
all chunks are scored by these rows instead, so that of questions and chunks only pairs are shuffled that could be among the best.

Defined results are those of :func:`retrieval.bm25`; a chunk is (kb_id, chunk). Null texts have no terms and count as rows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.store import ChunkStore, Conflict, Versioned
from ..tables import keep, release
from .retrieval import B, EPSILON, K1, SENT_TERMS, _scores, counts, posting_rows

BLOCK, BUCKETS = 128, 32
#: Dead keys, and terms asked for, that are sent to every task; more meet the postings by a shuffle.
SENT = 1_000_000
#: What rounding can move a score by.
EDGE = 1e-5


@dataclass
class IndexManifest:
    """of: the store's version; updates: folders of postings and of dead keys, in order; terms: the folder of term statistics."""

    version: int = 0
    token: str = ""
    of: int = 0
    updates: list[dict] = field(default_factory=list)
    terms: str = ""
    rows: int = 0
    length: int = 0
    mean: float = 0.0


def impact(tf: Column, length: Column, mean: float) -> Column:
    """What a posting adds to a score for a weight of 1."""
    return tf / (tf + K1 * (1 - B + B * length / F.lit(max(mean, 1e-300))))


def bucket_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, term, chunk, tf, length), in order, to blocks."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term = batch.column(1)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff([*first, n]))
        starts = np.flatnonzero(place % BLOCK == 0)
        ends = pa.array(np.concatenate([starts, [n]]), pa.int32())
        tf, length = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        of = pa.array(starts)
        lists = [pa.ListArray.from_arrays(ends, c) for c in (batch.column(2), batch.column(3), batch.column(4))]
        bounds = [pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), term.take(of), *lists, *bounds], names=["bucket", "term", "chunks", "tfs", "lengths", "most", "least"])


class SegmentIndex(Versioned):
    """An index at a path of its own, which driver and executors share."""

    kind = IndexManifest

    def update(self, store: ChunkStore, text: str = "text", until: int | None = None) -> int:
        """Bring the index up to a version of the store, the last one unless ``until`` names another; returns that version. After a compaction it is made anew."""
        m = self.manifest()
        of = until or store.manifest().version
        if m.version and m.of >= of:
            return m.of
        try:
            new, gone = store.changed_since(m.of, of) if m.version else (store.read(of), None)
        except Conflict:
            m = IndexManifest(m.version)
            new, gone = store.read(of), None
        name = uuid.uuid4().hex
        key = F.struct("kb_id", "chunk").alias("chunk")
        made = counts(new.select(key, F.col(text).alias("text")))
        made.write.parquet(f"{self.path}/counts/{name}")
        counted = self.spark.read.schema(made.schema).parquet(f"{self.path}/counts/{name}")
        lost = keep(counts(gone.select(key, F.col(text).alias("text"))), "lost-terms") if gone is not None else None
        added = self._sum(counted)
        rows, length = m.rows + new.count(), m.length + added
        dead = 0
        if gone is not None:
            gone.select(key).write.parquet(f"{self.path}/dead/{name}")
            dead = self.spark.read.parquet(f"{self.path}/dead/{name}").count()
            rows, length = rows - dead, length - self._sum(lost)
        self._write(posting_rows(counted), name)
        parts = [counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))]
        parts += [lost.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))] if lost is not None else []
        parts += [self.spark.read.parquet(f"{self.path}/terms/{m.terms}")] if m.terms else []
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").write.parquet(f"{self.path}/terms/{name}")
        raw = F.log(rows - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = self.spark.read.parquet(f"{self.path}/terms/{name}").agg(F.avg(raw)).first()[0] or 0.0
        if lost is not None:
            release(lost)
        done = IndexManifest(m.version + 1, "", of, [*m.updates, {"name": name, "dead": dead, "length": added, "counts": True}], name, rows, length, mean)
        if not self._publish(done):
            raise Conflict("another update was first")
        return of

    @staticmethod
    def _sum(counted: DataFrame) -> int:
        return int(counted.agg(F.sum("length")).first()[0] or 0)

    def _write(self, counted: DataFrame, name: str) -> None:
        """Postings in ranges of (bucket, term), a hot term being as many ranges as it takes, and in each of them best first.

        One number is the order: bucket and hash of the term, then the impact. Where two terms share it their runs are shorter, no more.
        """
        mean = counted.agg(F.avg("length")).first()[0] or 1.0
        rows = counted.select(bucket_of("term").alias("bucket"), "term", "chunk", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"))
        best = F.lit(2**31 - 1) - (impact(F.col("tf"), F.col("length"), mean) * (2**31 - 1)).cast("long")
        order = F.shiftleft(F.col("bucket").cast("long"), 57) + F.shiftleft(F.shiftrightunsigned(F.xxhash64("term"), 38), 31) + best
        sorted_ = rows.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order").drop("_order")
        chunk = counted.schema["chunk"].dataType.simpleString()
        blocks = sorted_.mapInArrow(_blocks, f"bucket int, term string, chunks array<{chunk}>, tfs array<int>, lengths array<int>, most int, least int")
        blocks.write.parquet(f"{self.path}/postings/{name}")

    def _asked(self, m: IndexManifest, queries: DataFrame) -> DataFrame:
        """(query, term, weight, df), kept: the terms of the queries that some chunk has."""
        asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
        raw = F.log(m.rows - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, EPSILON * m.mean).otherwise(raw)
        known = self.spark.read.parquet(f"{self.path}/terms/{m.terms}")
        return keep(asked.join(known, "term").select("query", "term", (F.col("times") * idf * (K1 + 1)).alias("weight"), "df"), "asked")

    def _met(self, m: IndexManifest, asked: DataFrame, few: bool) -> DataFrame:
        """The blocks of all segments that the queries' terms have, with what each can add at most; only parts of files with those terms are read."""
        buckets = [r[0] for r in asked.select(bucket_of("term")).distinct().collect()]  # at most BUCKETS
        mean, out = m.length / max(1, m.rows), None
        for i, u in enumerate(m.updates):
            if not u["length"]:  # no postings
                continue
            part = self.spark.read.parquet(f"{self.path}/postings/{u['name']}")
            part = part.filter(F.col("bucket").isin(buckets)).drop("bucket").withColumn("segment", F.lit(i))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return None
        most = F.col("weight") * impact(F.col("most"), F.col("least"), mean)
        return out.join(F.broadcast(asked.drop("df")) if few else asked.drop("df"), "term").withColumn("bound", most)

    def _scored(self, m: IndexManifest, blocks: DataFrame) -> DataFrame:
        """(query, chunk, score) of the blocks' postings that are not dead."""
        part = F.col("weight") * impact(F.col("x.tfs"), F.col("x.lengths"), m.length / max(1, m.rows))
        rows = blocks.select("query", "segment", "weight", F.explode(F.arrays_zip("chunks", "tfs", "lengths")).alias("x")).select("query", "segment", F.col("x.chunks").alias("chunk"), part.alias("part"))
        rows = self._living(m, rows)
        return rows.groupBy("query", "chunk").agg(F.sum("part").alias("score"))

    def _living(self, m: IndexManifest, rows: DataFrame) -> DataFrame:
        """``rows`` (chunk, segment, ...) without those of chunks that were hidden since."""
        dead, n = None, 0
        for i, u in enumerate(m.updates):
            if u["dead"]:
                own = self.spark.read.parquet(f"{self.path}/dead/{u['name']}").withColumn("hidden", F.lit(i))
                dead, n = own if dead is None else dead.unionByName(own), n + u["dead"]
        if dead is None:
            return rows
        dead = dead.groupBy("chunk").agg(F.max("hidden").alias("hidden"))
        rows = rows.join(F.broadcast(dead) if n <= SENT else dead, "chunk", "left")
        return rows.filter(F.col("hidden").isNull() | (F.col("segment") >= F.col("hidden"))).drop("hidden")

    def _by_rows(self, m: IndexManifest, asked: DataFrame, k: int) -> DataFrame:
        """(query, chunk, score) of what could be among a query's best, by the counts of all chunks that are not dead."""
        parts = [self.spark.read.parquet(f"{self.path}/counts/{u['name']}").withColumn("segment", F.lit(i)) for i, u in enumerate(m.updates) if u["length"]]
        rows = self._living(m, functools.reduce(DataFrame.unionByName, parts)).select("chunk", "length", "terms", "tfs")
        kinds = f"query {asked.schema['query'].dataType.simpleString()}, chunk {rows.schema['chunk'].dataType.simpleString()}, score double"
        return rows.mapInArrow(_scores(asked.toArrow().sort_by("term"), m.length / max(1, m.rows), k), kinds)

    def opened(self, m: IndexManifest, asked: DataFrame, k: int) -> DataFrame | None:
        """The blocks that could hold one of a query's k best chunks."""
        few = asked.count() <= SENT
        blocks = self._met(m, asked, few)
        if blocks is None:
            return None
        own = Window.partitionBy("query", "term").orderBy(F.desc("bound"))
        first = blocks.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
        best = first.groupBy("query", "term").agg(F.max("bound").alias("best"))
        at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        beat = self._scored(m, first).withColumn("_n", at).filter(F.col("_n") == k).select("query", F.col("score").alias("beat"))
        # a term of negative weight can take from a sum what a part of it promised
        whole = best.groupBy("query").agg(F.sum("best").alias("whole")).join(beat, "query", "left").join(asked.groupBy("query").agg(F.min("weight").alias("least_weight")), "query")
        figures = keep(best.join(whole, "query"), "bounds")
        figures = F.broadcast(figures) if few else figures
        others = F.col("whole") - F.col("best")
        reach = F.col("beat").isNull() | (F.col("least_weight") < 0) | (F.col("bound") + others >= F.col("beat") - EDGE)
        return blocks.join(figures, ["query", "term"]).filter(reach)

    def search(self, queries: DataFrame, k: int, version: int | None = None, by_rows: bool | None = None) -> DataFrame:
        """(query, kb_id, chunk, score, rank from 0): the k best chunks of each query with a score above zero, in a version of the index.

        ``by_rows``: whether chunks are scored by their counts rather than by blocks; by default if the queries' lists are longer than all chunks.
        """
        m = self.manifest(version)
        kind = queries.schema["query"].dataType.simpleString()
        asked = self._asked(m, queries) if m.terms else None
        n, met, nulls = asked.agg(F.count("*"), F.sum("df"), F.count_if(F.col("query").isNull())).first() if m.terms else (0, 0, 0)
        able = 0 < n <= SENT_TERMS and not nulls and all(u.get("counts") for u in m.updates)
        rows = self._by_rows(m, asked, k) if able and (met > m.length if by_rows is None else by_rows) else None
        blocks = self.opened(m, asked, k) if n and rows is None else None
        if blocks is None and rows is None:
            return self.spark.createDataFrame([], f"query {kind}, kb_id string, chunk string, score double, rank int")
        scores = (self._scored(m, blocks) if rows is None else rows).select("query", "chunk.*", F.round("score", 6).alias("score")).filter("score > 0")
        w = Window.partitionBy("query").orderBy(F.desc("score"), "chunk", "kb_id")
        return scores.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
