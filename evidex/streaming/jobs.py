"""Structured Streaming jobs: resumable ingest, log with a commit barrier, rate limits, windows, traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACES = 64


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], mode: str = "append"):
    """Everything that is there now, in batches; a later run goes on where this one ended."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return q


def every(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], interval: str = "60 seconds"):
    """A maintenance loop."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(put).start()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return put


def logged_first(log: Callable[[DataFrame, int], None], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that passes a batch on only once its log is written; both see the same rows."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            log(rows, number)
            emit(rows, number)
        finally:
            rows.unpersist()

    return put


def committed_tokens(tokens: DataFrame) -> DataFrame:
    """The text of each thread's last attempt, if that was committed: what earlier attempts streamed is dropped.

    ``tokens`` (thread, attempt, seq, token, event): event token, commit or discard.
    """
    w = Window.partitionBy("thread")
    last = tokens.withColumn("_last", F.max("attempt").over(w)).filter(F.col("attempt") == F.col("_last"))
    words = F.filter(F.array_sort(F.collect_list(F.struct("seq", "event", "token"))), lambda t: t["event"] == "token")
    return last.groupBy("thread").agg(F.array_join(F.transform(words, lambda t: t["token"]), "").alias("answer"), F.max((F.col("event") == "commit").cast("int")).alias("_done")).filter("_done = 1").drop("_done")


def committed_stream(stream: DataFrame) -> DataFrame:
    """(thread, attempt, answer) as soon as an attempt is committed: nothing of an attempt leaves before that.

    ``stream`` is as in :func:`committed_tokens`. A thread's state is its last attempt and that attempt's tokens; a later
    attempt drops them, rows of earlier ones come too late. Tokens of a committed attempt that come later give its answer
    again, so the last row of a thread counts.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, places, texts, done = state.get if state.exists else (-1, [], [], False)
        held, said = dict(zip(places, texts)), False
        rows = sorted((int(a), int(q), e, t) for b in batches for a, q, e, t in zip(b["attempt"], b["seq"], b["event"], b["token"].fillna("")))
        for a, q, event, token in rows:
            if a < attempt:
                continue
            if a > attempt:
                attempt, held, done = a, {}, False
            if event == "token":
                held[q] = token
            done |= event == "commit"
            said = True
        order = sorted(held)
        state.update((attempt, order, [held[q] for q in order], bool(done)))
        yield pd.DataFrame([(k[0], attempt, "".join(held[q] for q in order))] if done and said else [], columns=["thread", "attempt", "answer"])

    kind = stream.schema["thread"].dataType.simpleString()
    kept = "attempt long, places array<long>, texts array<string>, done boolean"
    return stream.groupBy("thread").applyInPandasWithState(step, f"thread {kind}, attempt long, answer string", kept, "append", GroupStateTimeout.NoTimeout)


def limited(stream: DataFrame, limit: int, seconds: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """A sliding window limit with state: only the times let in within the window are kept for a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        out = []
        for t, i in sorted((int(t.value // 1000), int(i)) for b in batches for t, i in zip(b[at], b["event_id"])):
            seen = [s for s in seen if s > t - seconds * 1_000_000]
            ok = len(seen) < limit
            if ok:
                seen.append(t)
            out.append((i, k[0], ok))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["event_id", key, "admitted"])

    return stream.groupBy(key).applyInPandasWithState(step, f"event_id long, {key} long, admitted boolean", "seen array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Counts by event-time window with a watermark: beyond the reference, a native extra."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts", key: str = "user_id") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def evicted(traces: DataFrame, most: int = TRACES) -> DataFrame:
    """Pending traces beyond the newest ``most`` of each registry, which are flushed as truncated."""
    w = Window.partitionBy("registry").orderBy(F.desc("seq"))
    return traces.withColumn("truncated", F.row_number().over(w) > most)
