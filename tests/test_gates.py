from pyspark.sql import functions as F

from evidex.operators import gates


def test_sources(spark):
    df = spark.createDataFrame([("a\\b/Report 2024.PDF",), ("x/",), ("notes.tar.gz",), (None,)], "p string")
    assert [r["k"] for r in df.select(gates.source_keys(F.col("p")).alias("k")).collect()] == [["report 2024.pdf", "report 2024"], ["x"], ["notes.tar.gz"], []]
    expected = spark.createDataFrame([(1, "dir/Report.pdf"), (1, "d9"), (1, "none.md")], "case_id int, source string")
    hits = spark.createDataFrame([(1, "d1", "report", 4), (1, "d9", "x", 2), (1, "d9", "x", 7)], "case_id int, doc string, title string, rank int")
    assert {r["source"]: r["rank"] for r in gates.sources_met(expected, hits).collect()} == {"dir/Report.pdf": 4, "d9": 2, "none.md": None}


def test_numbers():
    assert gates.numbers_match("12000万元", "收入为1.2亿元") and gates.numbers_match("123,456,789元", "约1.23亿元")
    assert not gates.numbers_match("123,456,789元", "约1.24亿元") and not gates.numbers_match("22.32", "22.32%") and not gates.numbers_match("5亿元", "无")
    assert gates.numbers_match("-22.55%", "同比下降22.55%") and gates.numbers_match("关键 词", "有关键词") and gates.numbers_match(None, "")
    assert gates.numbers_match("1000万元", "1004万元", 0.01) and not gates.numbers_match("1000万元", "1004万元")


def test_answer_checks(spark):
    shape = (
        "id int, answer string, citation_indices array<int>, citation_kbs array<string>, kb_id string, escalate boolean, intent string, score double, top_score double, elapsed double, expect_answerable boolean, "
        "expect_intent string, expect_all array<string>, expect_any array<string>, forbidden array<string>, min_citations int, max_citations int, expect_inline boolean, min_score double, min_top_score double, max_elapsed double"
    )
    rows = [
        (1, "A b [1]", [1], ["k"], "k", False, "kb", 7.0, 0.9, 1.0, True, "kb", ["ab"], ["x", "B"], ["zz"], 1, 2, True, 6.0, None, 5.0),
        (2, "x [3]", [1, 3], ["k", "o"], "k", True, None, None, None, 9.0, True, "kb", None, None, ["x"], 3, None, True, 6.0, 0.1, 5.0),
        (3, "plain", [], [], "k", False, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r["id"]: r for r in gates.answer_checks(spark.createDataFrame(rows, shape)).collect()}
    assert got[1]["passed"] and got[3]["passed"] and len(got[3]["checks"]) == 3
    assert not any(v for k, v in got[2]["checks"].items())
    relaxed = {r["policy"]: r["n_passed"] for r in gates.relaxed(gates.answer_checks(spark.createDataFrame(rows, shape)), {"A": [], "B": list(got[2]["checks"])}).collect()}
    assert relaxed == {"A": 2, "B": 3}


def test_baseline_and_required(spark):
    expected = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "case_id string, baseline_passed boolean")
    results = spark.createDataFrame([("a", True), ("b", False), ("x", True), ("x", True)], "case_id string, passed boolean")
    got = sorted((r["finding"], r["case_id"]) for r in gates.baseline_findings(results, expected, 3).collect())
    assert got == [("missing", "c"), ("regressed", "b"), ("repeated", "x"), ("unexpected", "x")]
    assert gates.baseline_findings(results, expected, 9).filter("finding = 'too few passed'").count() == 1
    rows = spark.createDataFrame([("a", True, ["k"]), ("b", False, ["k"]), ("c", True, ["o"]), ("d", True, None)], "case_id string, passed boolean, citation_kbs array<string>")
    assert {r["case_id"]: r["finding"] for r in gates.required(rows, ["a", "b", "c", "d", "e"], "k").collect()} == {"b": "failed", "c": "foreign citation", "d": "no citations", "e": "missing"}


def test_diagnoses(spark):
    ev = spark.createDataFrame([(1, "营业收入 123,456.78"), (2, "利润 123,456.78"), (3, "利润 1234567"), (4, "无此"), (5, "利润 999")], "item int, excerpt string")
    chunks = spark.createDataFrame([("营业收入123,456.78元",), ("123456 8",)], "text string")
    assert {r["item"]: r["class"] for r in gates.integrity(ev, chunks).collect()} == {1: "INTACT", 2: "NUMBER_ONLY", 3: "BROKEN", 4: "MISSING", 5: "MISSING"}
    q = spark.createDataFrame([(1, "2024"), (2, "2024"), (3, "1999")], "query int, period string")
    c = spark.createDataFrame([("d1", "2024", True), ("d1", "2024", False), ("d2", "2024", True)], "doc string, period string, is_table boolean")
    locked = spark.createDataFrame([(1, "d1"), (2, "d9")], "query int, doc string")
    got = {r["query"]: (r["period_pool"], r["locked_pool"], r["outcome"]) for r in gates.route_pools(q, c, locked).collect()}
    assert got == {1: (2, 1, "routed"), 2: (2, 0, "not in pool"), 3: (0, 0, "pool empty")}
    ocr = spark.createDataFrame([("甲 乙 丙", 3, ["甲乙"]), ("甲", 3, []), (None, 0, ["x"])], "text string, min_chars int, terms array<string>")
    assert [r["passed"] for r in gates.recognised(ocr).collect()] == [True, False, False]


def test_pools_meet_no_pairs_and_count_a_locked_document_once(spark):
    q = spark.range(20_000).select(F.col("id").alias("query"), (F.col("id") % 2).alias("period"))
    c = spark.range(20_000).select(F.col("id").alias("doc"), (F.col("id") % 2).alias("period"), F.lit(True).alias("is_table"))
    locked = q.select("query", F.col("query").alias("doc"))
    pools = gates.route_pools(q, c, locked.unionByName(locked))
    assert [tuple(r) for r in pools.groupBy("period_pool", "locked_pool", "outcome").count().collect()] == [(10_000, 1, "routed", 20_000)]
