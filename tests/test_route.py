"""The structured route over small corpora."""

from pyspark.sql import functions as F

from evidex.operators import retrieval, route

CHUNK = "chunk string, doc string, n int, title string, text string, is_table boolean, report_period string, section_path string, table_name string, statement_scope string, metrics array<string>"


BASE = {"title": "某公司2024年年度报告", "is_table": True, "report_period": "2024年度", "section_path": "主要会计数据", "table_name": "", "statement_scope": "consolidated", "metrics": []}
REVENUE = [
    {"chunk": "b", "text": "| 营业收入 | 1,200.50 |", "metrics": ["营业收入"]},
    {"chunk": "c", "text": "| 营业收入 | 1.0 |", "report_period": "2023年度"},
    {"chunk": "d", "text": "| 项目 | 说明 |"},
    {"chunk": "e", "text": "公司营业收入为 3.5 亿元", "is_table": False},
]
MANY = [{"chunk": f"r{i}", "text": f"| 营业收入 | {i}.5 | 2024年 多少 |"} for i in range(9)] + [{"chunk": "rd", "text": "| 研发费用 | 7.5 |"}]
UNDATED = [{"chunk": "t", "text": "| 归母净利润 | 5.5 |", "report_period": "", "section_path": ""}, {"chunk": "o", "text": "| 归母净利润 | 6.5 |", "report_period": "2022年度", "section_path": ""}]
CAUSES = [
    {"chunk": "t", "text": "| 营业收入 | 5.5 |"},
    {"chunk": "n", "text": "营业收入增长 5.5%，主要系销量上升所致", "is_table": False},
    {"chunk": "m", "text": "营业收入变动原因说明：由于 3.5 万元订单", "is_table": False},
    {"chunk": "p", "text": "营业收入 4.5 万元", "is_table": False},
]
#: question, the locked document's chunks (None: nothing is locked), what search found, what is expected
CASES = {
    "tables of the locked company and period come first": ("某公司2024年营业收入是多少", REVENUE, ["a", "e", "d"], [("e", "kept"), ("b", "route"), ("a", "search"), ("d", "search")]),
    "what search has found stays where it is": ("某公司2024年营业收入是多少", REVENUE, ["a", "b"], [("a", "search"), ("b", "search")]),
    "no period": ("某公司营业收入是多少", REVENUE, ["a"], [("a", "search")]),
    "no metric": ("某公司2024年的客户", REVENUE, ["a"], [("a", "search")]),
    "no company": ("某公司2024年营业收入", None, ["a"], [("a", "search")]),
    "each metric gets its own pass": ("某公司2024年营业收入和研发费用是多少", MANY, ["x"], None),
    "without a strict hit the document is searched": ("某公司2024年归母净利润", UNDATED, ["x"], [("t", "route"), ("x", "search")]),
    "causes come before tables": ("某公司2024年营业收入变动原因", CAUSES, ["x"], [("m", "route"), ("n", "route"), ("t", "route"), ("x", "search")]),
}


def test_routes(spark):
    names = [f.split()[0] for f in CHUNK.split(", ")]
    corpus, questions, locked, hits = [], [], [], []
    for i, (text, rows, found, _) in enumerate(CASES.values()):
        questions.append((i, text))
        hits += [(i, f"{i}{c}", r) for r, c in enumerate(found)]
        for r in rows or ():
            r = BASE | {"n": len(corpus), "doc": f"d{i}"} | r
            corpus.append(tuple((r | {"chunk": f"{i}{r['chunk']}"})[n] for n in names))
        if rows:
            locked.append((i, f"d{i}"))
    corpus.append(tuple((BASE | {"n": 999, "doc": "other", "chunk": "other", "text": "| 营业收入 | 9.5 |"})[n] for n in names))
    pool = route.pools(spark.createDataFrame(questions, "query int, text string"), spark.createDataFrame(corpus, CHUNK), spark.createDataFrame(locked, "query int, doc string"))
    got = {}
    for r in route.routed(spark.createDataFrame(hits, "query int, chunk string, rank int"), pool).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["chunk"][1:], r["source"]))
    for i, (name, (_, _, _, want)) in enumerate(CASES.items()):
        if want is not None:
            assert got[i] == want, name
        else:
            own = {c for c, s in got[i] if s == "route"}
            assert "rd" in own and own >= {f"r{k}" for k in range(8)}, name


def test_periods_and_numbers(spark):
    df = spark.createDataFrame([("某公司2024年和2023年营业收入", "营业收入 1,200"), ("2025 年半年度净利润", "第 12 页 2024"), ("2024年的天气", "600519"), ("", "公司 600519"), (None, None), ("2024年营业收入，2024年", "1.5")], "q string, t string")
    rows = df.select(route.periods_asked(F.col("q")).alias("p"), route.has_number(F.col("t")).alias("n")).collect()
    assert [r["p"] for r in rows] == [["2024年度", "2023年度"], ["2025年半年度"], [], [], [], ["2024年度"]]
    assert [r["n"] for r in rows] == [True, False, False, True, False, True]


def test_profiles_merge(spark):
    df = spark.createDataFrame([("母公司研发费用为什么增长", "合并营业收入 利润表")], "a string, b string")
    one = retrieval.merged_profile(F.array(retrieval.profile(F.col("a")), retrieval.profile(F.col("b"))), F.col("a"))
    p = df.select(one.alias("p")).first()["p"]
    assert (p["groups"], p["scope"], p["is_cause"], p["is_numeric"], p["sections"]) == (["revenue", "rd_expense"], "parent", True, False, ["利润表"])
