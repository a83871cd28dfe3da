"""Where results go: chunk stores, manifests, reports, logs and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uuid5
from .store import ChunkStore


def point_id(kb_id: Column, chunk_id: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """A physical id that two knowledge bases cannot share: the UUID of a name that holds both ids."""
    return uuid5(F.to_json(F.struct(chunk_id.alias("chunk_id"), kb_id.alias("kb_id"))), namespace)


def checked_vectors(df: DataFrame, dimension: int, vec: str = "vec") -> DataFrame:
    """The rows, or an error at the first vector of another dimension or with a component that is no finite number."""
    bad = (F.size(vec) != dimension) | ~F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.withColumn(vec, F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("not a vector of this store"))).otherwise(F.col(vec)))


def write_chunks(new: DataFrame, path: str, kb_id: str) -> int:
    """Replace chunks of one knowledge base by new ones of the same id, in one commit of the store at ``path``; others stay. Returns the number of new rows."""
    store = ChunkStore(new.sparkSession, path)
    version = store.upsert(new.withColumn("kb_id", F.lit(kb_id)))
    return store.added(version).count()


def with_default_kb(df: DataFrame) -> DataFrame:
    return df.withColumn("kb_id", F.coalesce("kb_id", F.lit("default")))


def backup_manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files with their content."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def verification(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings on a migrated store (kb_id, chunk, physical_id, text) against what was to be there: repeated ids, missing, extra, changed."""
    repeated = stored.groupBy("physical_id").count().filter("count > 1").select(F.col("physical_id").cast("string").alias("id"), F.lit("repeated").alias("finding"))
    s = stored.select("kb_id", "chunk", F.sha2(F.col("text").cast("binary"), 256).alias("have"))
    e = expected.select("kb_id", "chunk", F.sha2(F.col("text").cast("binary"), 256).alias("want"))
    said = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "changed")
    other = s.join(e, ["kb_id", "chunk"], "full").select(F.concat_ws("/", "kb_id", "chunk").alias("id"), said.alias("finding")).filter("finding IS NOT NULL")
    return repeated.unionByName(other)


def log_rows(results: DataFrame) -> DataFrame:
    """Retrieval log rows: hits as JSON with 120 characters of text, scores to four decimals, answers of 500 characters."""
    hits = F.transform("hits", lambda h: F.struct(h["chunk"].alias("chunk"), F.round(h["score"], 4).alias("score"), F.substring(h["text"], 1, 120).alias("text")))
    return results.withColumn("hits", F.to_json(hits)).withColumn("evidence_score", F.round("evidence_score", 4)).withColumn("answer", F.substring("answer", 1, 500))


def backfilled(log: DataFrame, scores: DataFrame) -> DataFrame:
    """The last log row of each question with its late score."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("id"))) == 1
    both = log.withColumn("_last", last).join(scores.select("question", F.col("faithfulness").alias("_new")), "question", "left")
    return both.withColumn("faithfulness", F.when(F.col("_last") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("faithfulness"))).drop("_last", "_new")


SECRET = "(?i)((?:api[_-]?key|token|secret|password|authorization)[\"']?\\s*[:=]\\s*[\"']?)[^\\s\"',}]+"


def trace_lines(events: DataFrame, clip: int = 2000, most: int = 40) -> DataFrame:
    """Trace events as JSON lines without secrets; long texts and lists are clipped."""
    text = F.regexp_replace(F.to_json(F.struct(*events.columns)), SECRET, "$1***")
    lists = [F.slice(c, 1, most).alias(c) if t.startswith("array") else (F.substring(c, 1, clip).alias(c) if t == "string" else F.col(c)) for c, t in events.dtypes]
    return events.select(*lists).select(text.alias("value"))


def prometheus(metrics: DataFrame, prefix: str = "evidex_") -> DataFrame:
    """(name, kind, value) as lines of the text exposition format."""
    name = F.concat(F.lit(prefix), F.regexp_replace("name", "[^A-Za-z0-9_]", "_"))
    return metrics.select(F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("kind"), F.lit("\n"), name, F.lit(" "), F.col("value").cast("string")).alias("value"))


def sample_files(files: DataFrame, n: int = 3) -> DataFrame:
    """A fixed small choice: the smallest and the largest PDF, the first DOCX, then the rest by path."""
    from pyspark.sql import Window

    pdf = F.lower("path").endswith(".pdf")
    by = Window.partitionBy(F.regexp_extract(F.lower("path"), "\\.([a-z0-9]+)$", 1))
    small, large, first = (F.row_number().over(by.orderBy(*o)) == 1 for o in (("length", "path"), (F.desc("length"), "path"), ("path",)))
    rank = F.when(pdf & small, 0).when(pdf & large, 1).when(F.lower("path").endswith(".docx") & first, 2).otherwise(3)
    return files.withColumn("_rank", rank).orderBy("_rank", "path").limit(n).drop("_rank")
