import random

import pytest
from pyspark.sql import functions as F

from evidex.operators import lexical, retrieval
from evidex.sources.store import ChunkStore

ROWS = "kb_id string, doc string, chunk long, text string"


def corpus(n, start=0, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    return [("k", f"d{i % 7}", i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(120)], k=rng.randint(0, 40)))) for i in range(start, start + n)]


@pytest.fixture
def both(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store")), lexical.SegmentIndex(spark, str(tmp_path / "index"))


def asked(spark):
    return spark.createDataFrame([(1, "w0 w1 w2"), (2, "w90 w5 w5"), (3, "w119"), (4, "nothing here"), (5, ""), (6, None), (7, "w0 w0 w77")], "query int, text string")


def same(spark, store, index, k=10):
    got = sorted(tuple(r) for r in index.search(asked(spark), k).select("query", "chunk", "score", "rank").collect())
    want = sorted(tuple(r) for r in retrieval.bm25(store.read().select("chunk", "text"), asked(spark), k).select("query", "chunk", "score", "rank").collect())
    assert got == want and got
    return got


def test_updates_equal_an_index_made_anew(spark, both):
    store, index = both
    store.append(spark.createDataFrame(corpus(400), ROWS))
    assert index.update(store) == 1
    same(spark, store, index)
    old = [tuple(r) for r in index.search(asked(spark), 10).orderBy("query", "rank").collect()]
    store.append(spark.createDataFrame([*corpus(40, 400, 1), ("k", "d0", 999, None)], ROWS))
    store.upsert(spark.createDataFrame(corpus(30, 100, 2), ROWS))
    store.delete(spark.createDataFrame([("k", "d3")], "kb_id string, doc string"))
    assert index.update(store) == 4 and index.update(store) == 4
    same(spark, store, index)
    m = index.manifest()
    assert m.rows == store.read().count() and [u["dead"] > 0 for u in m.updates] == [False, True]
    # an older version of the index still answers as it did
    assert [tuple(r) for r in index.search(asked(spark), 10, 1).orderBy("query", "rank").collect()] == old
    store.compact()
    index.update(store)
    assert len(index.manifest().updates) == 1
    same(spark, store, index)


def test_an_update_reads_what_is_new(spark, both):
    """The scan of rows that an update makes is of the new folders only."""
    store, index = both
    store.append(spark.createDataFrame(corpus(50), ROWS))
    first = index.update(store)
    store.append(spark.createDataFrame(corpus(5, 50, 3), ROWS))
    new, gone = store.changed_since(first)
    assert {f.split("segment=")[1].split("/")[0] for f in new.inputFiles()} == {s for s, v in store.manifest().segments.items() if v == 2}
    assert gone.count() == 0 and index.update(store) == 2
    same(spark, store, index)


def test_blocks_that_cannot_matter_stay_closed(spark, both, monkeypatch):
    """A list ends where what is left of it is too little: soon for a question of one term, later for terms whose best postings add up."""
    store, index = both
    monkeypatch.setattr(lexical, "BLOCK", 8)
    store.append(spark.createDataFrame(corpus(3000, seed=5), ROWS))
    index.update(store)
    m = index.manifest()
    for text, share in (("w40", 0.5), ("w3", 0.5), ("w1 w100", 1)):
        q = spark.createDataFrame([(1, text)], "query int, text string")
        terms = index._asked(m, q)
        every, opened = index._met(m, terms, True).count(), index.opened(m, terms, 3).count()
        assert opened <= every * share and every > 10
        got = [tuple(r) for r in index.search(q, 3).select("query", "chunk", "score", "rank").orderBy("rank").collect()]
        assert got == [tuple(r) for r in retrieval.bm25(store.read().select("chunk", "text"), q, 3).select("query", "chunk", "score", "rank").orderBy("rank").collect()]


def test_empty_stores_and_no_common_terms(spark, both):
    store, index = both
    assert index.search(asked(spark), 5).count() == 0
    store.append(spark.createDataFrame([("k", "d", 1, None), ("k", "d", 2, "")], ROWS))
    index.update(store)
    assert index.search(asked(spark), 5).count() == 0
    assert index.search(asked(spark).limit(0), 5).count() == 0


def test_a_version_of_files_needs_no_call_for_each(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(40).select(F.col("id").alias("chunk"), F.lit("a b").alias("text")).repartition(8).write.parquet(path)
    df = spark.read.parquet(path)
    one = retrieval.version(df)
    assert retrieval.version(spark.read.parquet(path)) == one
    spark.range(1).select(F.col("id").alias("chunk"), F.lit("a b").alias("text")).write.mode("append").parquet(path)
    assert retrieval.version(spark.read.parquet(path)) != one


def test_questions_of_long_lists_are_scored_by_rows(spark, both):
    """Whether by blocks or by rows of counts, the hits are the same, dead chunks left out."""
    store, index = both
    store.append(spark.createDataFrame(corpus(300, seed=8), ROWS))
    index.update(store)
    store.upsert(spark.createDataFrame(corpus(60, 20, 9), ROWS))
    store.delete(spark.createDataFrame([("k", "d2")], "kb_id string, doc string"))
    index.update(store)
    rows, blocks, own = ([tuple(r) for r in index.search(asked(spark), 10, by_rows=b).orderBy("query", "rank").collect()] for b in (True, False, None))
    assert rows == blocks == own and rows
