from pyspark.sql import functions as F

from evidex.streaming import jobs

TOKENS = "thread string, attempt long, seq long, token string, event string"


def test_commit_barrier_goes_on_from_a_checkpoint(spark, tmp_path):
    """Three batches over two runs of the query: what is emitted last equals the batch over all rows, and nothing leaves uncommitted."""
    batches = [
        [("a", 1, 0, "Hel", "token"), ("a", 1, 1, "lo", "token"), ("b", 1, 0, "lost", "token"), ("c", 1, 0, "never", "token"), ("d", 1, 1, "y", "token"), ("d", 1, 0, "x", "token"), ("d", 1, 2, None, "commit")],
        [("a", 1, 2, None, "commit"), ("b", 1, 1, None, "discard"), ("b", 2, 0, "kept", "token")],
        [("b", 2, 1, " text", "token"), ("b", 2, 2, None, "commit"), ("b", 1, 3, "late", "token"), ("c", 2, 0, "open", "token"), ("e", 3, 0, None, "commit")],
    ]
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    everything = spark.createDataFrame([r for b in batches for r in b], TOKENS)

    def run():
        stream = jobs.table_stream(spark, source, everything.schema, 1)
        jobs.run_once(jobs.committed_stream(stream), checkpoint, jobs.to_parquet(out))
        return {r["thread"]: r["answer"] for r in spark.read.parquet(out).groupBy("thread").agg(F.max_by("answer", "batch").alias("answer")).collect()}

    for b in batches[:2]:
        spark.createDataFrame(b, TOKENS).coalesce(1).write.mode("append").parquet(source)
    assert run() == {"a": "Hello", "d": "xy"}
    spark.createDataFrame(batches[2], TOKENS).coalesce(1).write.mode("append").parquet(source)
    want = {r["thread"]: r["answer"] for r in jobs.committed_tokens(everything).collect()}
    assert run() == want == {"a": "Hello", "d": "xy", "b": "kept text", "e": ""}
