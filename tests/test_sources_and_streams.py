import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from evidex.operators import ops
from evidex.sources import readers, sinks
from evidex.streaming import jobs


def test_files_and_parsers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_bytes("é".encode() + b"\xff x")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.bin").write_bytes(b"no")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert rows["a.MD"]["text"] == "é x" and rows["b.pdf"]["text"] is None
    assert sorted(r["extension"] for r in readers.scan(spark, str(tmp_path)).collect()) == ["md", "pdf"]
    (tmp_path / "m.tsv").write_text("a.txt\t1\tAB\n../x\t2\tcd\nA.txt\t3\tef\na.txt\t1\tab\n")
    entries, found = readers.manifest(spark, str(tmp_path / "m.tsv"), 5)
    assert entries.count() == 4 and sorted(r["finding"] for r in found.collect()) == ["clash", "count", "repeated", "unsafe"]
    (tmp_path / "r.json").write_text(json.dumps({"reports": [{"summary": {"pass_rate": 0.9, "name": "x"}}]}))
    assert [tuple(r) for r in readers.report_summary(spark, str(tmp_path / "r.json")).collect()] == [("pass_rate", 0.9)]
    (tmp_path / "f.csv").write_text('question,answer,similar\nq1,a1,"x;y, z"\n,a2,\nq3,,\n')
    good, bad = readers.faq(spark, str(tmp_path / "f.csv"))
    assert [r["similar"] for r in good.collect()] == [["x", "y", "z"]] and sorted(r["reason"] for r in bad.collect()) == ["no answer", "no question"]


def test_table_markdown_and_layout(spark):
    df = spark.createDataFrame([([["a", "b"], ["1\n2"], ["3", "4"]],), ([["a"]],)], "r array<array<string>>")
    got = [r["m"] for r in df.select(readers.table_markdown(F.col("r")).alias("m")).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 2 |  |\n| 3 | 4 |", None]
    boxes = [(1, 0.0, 0.0, 10.0, 10.0, "a", 100.0), (1, 40.0, 2.0, 10.0, 10.0, "b", 100.0), (1, 52.0, 1.0, 10.0, 10.0, "c", 100.0), (1, 0.0, 30.0, 10.0, 10.0, "d", 100.0)]
    rows = readers.layout_rows(spark.createDataFrame(boxes, "page int, x double, y double, width double, height double, text string, page_width double"))
    assert [r["line"] for r in rows.orderBy("row_no").collect()] == ["a | b c", "d"]


def test_store_upsert_and_checks(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "chunk string, text string")
    assert sinks.write_chunks(df, path, "k1") == 2 and sinks.write_chunks(df, path, "k2") == 2
    sinks.write_chunks(spark.createDataFrame([("2", "new"), ("3", "c")], "chunk string, text string"), path, "k1")
    assert {(r["chunk"], r["text"]) for r in readers.chunks(spark, path, "k1").collect()} == {("1", "a"), ("2", "new"), ("3", "c")}
    assert readers.chunks(spark, path, "k2", {"text": {"$ne": "a"}}).count() == 1
    vec = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("nan")],)], "vec array<double>")
    assert sinks.checked_vectors(vec.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="not a vector"):
        sinks.checked_vectors(vec, 2).collect()
    stored = spark.createDataFrame([("k", "1", "p", "x"), ("k", "2", "p", "y")], "kb_id string, chunk string, physical_id string, text string")
    want = spark.createDataFrame([("k", "1", "z"), ("k", "3", "y")], "kb_id string, chunk string, text string")
    assert sorted(r["finding"] for r in sinks.verification(stored, want).collect()) == ["changed", "extra", "missing", "repeated"]


def test_text_sinks(spark):
    df = spark.createDataFrame([("hits total", "counter", 3.0)], "name string, kind string, value double")
    assert sinks.prometheus(df).first()["value"] == "# TYPE evidex_hits_total counter\nevidex_hits_total 3.0"
    t = spark.createDataFrame([("api_key=abc123 ok", list(range(50)))], "m string, l array<int>")
    line = json.loads(sinks.trace_lines(t).first()["value"])
    assert line["m"] == "api_key=*** ok" and len(line["l"]) == 40


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, i % 3, "view" if i % 2 else "click", t0 + dt.timedelta(minutes=7 * i)) for i in range(60)], "event_id long, user_id long, event_type string, ts timestamp")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(3).write.parquet(src)
    stream = jobs.table_stream(spark, src, events.schema, 1)
    jobs.run_once(stream, str(tmp_path / "c1"), jobs.to_parquet(out))
    jobs.run_once(stream, str(tmp_path / "c1"), jobs.to_parquet(out))  # nothing is left: nothing is doubled
    assert spark.read.parquet(out).count() == 60
    one = jobs.table_stream(spark, src, events.schema, 100)
    jobs.run_once(jobs.limited(one, 2, 3600), str(tmp_path / "c2"), jobs.to_parquet(str(tmp_path / "o2")))
    got = {(r["event_id"], r["admitted"]) for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    assert got == {(r["event_id"], r["admitted"]) for r in ops.admitted(events, 2, 3600).collect()}
    jobs.run_once(jobs.windowed(one), str(tmp_path / "c3"), jobs.to_parquet(str(tmp_path / "o3")))
    closed = {(r["start"], r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "o3")).collect()}
    batch = {tuple(r) for r in events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n").collect()}
    assert closed and closed <= batch


def test_commit_barrier(spark):
    rows = [("a", 0, 0, "bad", "token"), ("a", 0, 1, "", "discard"), ("a", 1, 0, "go", "token"), ("a", 1, 1, "od", "token"), ("a", 1, 2, "", "commit"), ("b", 0, 0, "x", "token")]
    df = spark.createDataFrame(rows, "thread string, attempt int, seq int, token string, event string")
    assert [tuple(r) for r in jobs.committed_tokens(df).collect()] == [("a", "good")]


def test_log_is_written_before_a_batch_goes_on(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "event_id")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []

    def emit(batch, number):
        logged = spark.read.parquet(f"{tmp_path}/log").count()
        seen.append((batch.count(), logged))

    stream = jobs.table_stream(spark, f"{tmp_path}/in", rows.schema)
    jobs.run_once(stream, f"{tmp_path}/cp", jobs.logged_first(jobs.to_parquet(f"{tmp_path}/log"), emit))
    assert sum(n for n, _ in seen) == 5 and all(logged >= n for n, logged in seen)
