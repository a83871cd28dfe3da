"""Reports written from the numbers of suppliers, read again: what comes out must be the numbers that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decimal_text
from ..operators import binding, blocks, chunking, facts, retrieval, route, verify
from ..tables import spread
from .registry import query, table

N = "\n"
#: Statement, its scope and unit, by the supplier's key.
KINDS = (("合并利润表", "consolidated", "万元"), ("母公司利润表", "parent", "元"), ("利润表", "unknown", "百万元"))


def numbers(spark, sf_dir) -> DataFrame:
    """(k, a, b, c, d, share, kind): two years' revenue and research expense, and a change."""
    # texts are read in Python, which a small file's one partition would do in one task
    s = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("k"), F.abs("s_acctbal").cast("decimal(12,2)").alias("x"))
    money = {"a": F.col("x") + 12000, "b": F.col("k") + F.lit(20000.25).cast("decimal(12,2)"), "c": F.col("x") + F.lit(30000.5).cast("decimal(12,2)"), "d": F.col("k") * 3 + F.lit(40000.75).cast("decimal(12,2)")}
    share = (F.col("k") % 50 + F.lit(0.25).cast("decimal(4,2)")).cast("decimal(12,2)")
    return s.select("k", *[v.cast("decimal(12,2)").alias(n) for n, v in money.items()], share.alias("share"), (F.col("k") % 3).cast("int").alias("kind"))


_NUMBERS = """
    x AS (SELECT s_suppkey k, CAST(abs(s_acctbal) AS DECIMAL(12,2)) x FROM supplier),
    n AS (SELECT k, CAST(x + 12000 AS DECIMAL(12,2)) a, CAST(k + 20000.25 AS DECIMAL(12,2)) b, CAST(x + 30000.5 AS DECIMAL(12,2)) c, CAST(k * 3 + 40000.75 AS DECIMAL(12,2)) d,
                 CAST(k % 50 + 0.25 AS DECIMAL(12,2)) AS share, CAST(k % 3 AS INTEGER) kind FROM x)"""
_SCALE = "CASE kind WHEN 0 THEN 10000 WHEN 1 THEN 1 ELSE 1000000 END"
_UNIT = "CASE kind WHEN 0 THEN '万元' WHEN 1 THEN '元' ELSE '百万元' END"
_SCOPE = "CASE kind WHEN 0 THEN 'consolidated' WHEN 1 THEN 'parent' ELSE 'unknown' END"
_RAW = "format('{{:,.2f}}', CAST({} AS DOUBLE))"


def raw(c: str) -> F.Column:
    return F.format_number(F.col(c), 2)


def of_kind(i: int) -> F.Column:
    return F.element_at(F.array(*[F.lit(k[i]) for k in KINDS]), F.col("kind") + 1)


def cells(*items) -> F.Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[x if not isinstance(x, str) else F.lit(x) for x in items]), F.lit(" |"))


def reports(spark, sf_dir) -> DataFrame:
    """A statement of each supplier as a Markdown table, with a note column and one of changes."""
    lines = [
        of_kind(0), F.concat(F.lit("单位："), of_kind(2)), F.lit("2024年年度报告"), cells("项目", "附注", "2024年度", "2023年度", "同比增减(%)"), cells(*["---"] * 5),
        cells("营业收入", "五、1", raw("a"), raw("b"), raw("share")), cells("其他收益", "", "5", "6", "7"), cells("研发费用", "", F.concat(F.lit("("), raw("c"), F.lit(")")), raw("d"), raw("share")),
    ]
    return numbers(spark, sf_dir).select("k", F.concat_ws(N, *lines).alias("text"))


@query(f"""WITH {_NUMBERS}
    SELECT k, '营业收入' metric, {_RAW.format("a")} raw_value, CAST(a * {_SCALE} AS DECIMAL(30,6)) canonical_value, {_UNIT} unit, {_SCOPE} statement_scope, '2024年度' report_period FROM n
    UNION ALL SELECT k, '营业收入', {_RAW.format("b")}, CAST(b * {_SCALE} AS DECIMAL(30,6)), {_UNIT}, {_SCOPE}, '2023年' FROM n
    UNION ALL SELECT k, '研发费用', '(' || {_RAW.format("c")} || ')', CAST(-c * {_SCALE} AS DECIMAL(30,6)), {_UNIT}, {_SCOPE}, '2024年度' FROM n
    UNION ALL SELECT k, '研发费用', {_RAW.format("d")}, CAST(d * {_SCALE} AS DECIMAL(30,6)), {_UNIT}, {_SCOPE}, '2023年' FROM n""")
def report_facts(spark, sf_dir):
    return _fact_rows(reports(spark, sf_dir))


def _fact_rows(rows: DataFrame) -> DataFrame:
    return facts.with_facts(rows).select("k", F.inline("facts"))


@query(f"""WITH {_NUMBERS} SELECT k, CASE kind WHEN 0 THEN '合并利润表' WHEN 1 THEN '母公司利润表' ELSE '利润表' END table_name, {_SCOPE} statement_scope, '2024年度' report_period, {_UNIT} unit, TRUE is_table FROM n""")
def report_contexts(spark, sf_dir):
    return reports(spark, sf_dir).select("k", F.inline(F.array(facts.table_context("text"))))


@query(f"""WITH {_NUMBERS}
    SELECT k, '营业收入|研发费用' metrics, 4 n_facts, CAST(a * {_SCALE} AS DECIMAL(30,6)) first_value FROM n""")
def report_fact_fields(spark, sf_dir):
    f = F.col("facts")
    of_year = F.filter(f, lambda x: (x["metric"] == "营业收入") & (x["report_period"] == "2024年度"))
    return facts.with_facts(reports(spark, sf_dir)).select("k", F.array_join(facts.metric_names(f), "|").alias("metrics"), F.size(f).alias("n_facts"), of_year[0]["canonical_value"].alias("first_value"))


@query(f"""WITH {_NUMBERS}
    SELECT k, '营业收入' metric, {_RAW.format("a")} raw_value, CAST(a * 10000 AS DECIMAL(30,6)) canonical_value, '2024年' report_period FROM n
    UNION ALL SELECT k, '营业收入', {_RAW.format("b")}, CAST(b * 10000 AS DECIMAL(30,6)), '2023年' FROM n
    UNION ALL SELECT k, '归属于上市公司股东的净利润', {_RAW.format("c")}, CAST(c * 10000 AS DECIMAL(30,6)), '2024年' FROM n
    UNION ALL SELECT k, '归属于上市公司股东的净利润', {_RAW.format("d")}, CAST(d * 10000 AS DECIMAL(30,6)), '2023年' FROM n""")
def report_plain_lines(spark, sf_dir):
    """A table whose cells stand in lines: only rows with as many amounts as the header has periods count. White space does not part numbers, units do."""

    def line(label, *names):
        return F.concat_ws(" ", F.lit(label), *[F.concat(raw(n), F.lit("万元")) for n in names])

    lines = [F.lit("主要会计数据"), F.lit("单位：元"), F.lit("项目 2024年 2023年"), line("营业收入", "a", "b"), line("研发费用", "a", "b", "c"), line("归母净利润", "c", "d")]
    return _fact_rows(numbers(spark, sf_dir).select("k", F.concat_ws(N, *lines).alias("text"))).select("k", "metric", "raw_value", "canonical_value", "report_period")


def answers_of(spark, sf_dir) -> DataFrame:
    n = numbers(spark, sf_dir)
    said = F.concat(F.lit("2024年母公司营业收入为"), raw("a"), F.lit("万元[1]，同比下降"), F.col("share").cast("string"), F.lit("%。\n2023年合并研发费用"), raw("d"), F.lit("元[2]。"))
    return n.withColumn("answer", said)


@query(f"""WITH {_NUMBERS}
    SELECT k, {_RAW.format("a")} || '万元' raw, CAST(a AS DECIMAL(30,6)) AS number, '万元' unit, CAST(a * 10000 AS DECIMAL(38,6)) canonical_value, FALSE is_percent, 'revenue' metric, '2024年' period, 'parent' AS scope FROM n
    UNION ALL SELECT k, CAST(share AS VARCHAR) || '%', CAST(-share AS DECIMAL(30,6)), '%', CAST(-share AS DECIMAL(38,6)), TRUE, 'revenue', '2024年', 'parent' FROM n
    UNION ALL SELECT k, {_RAW.format("d")} || '元', CAST(d AS DECIMAL(30,6)), '元', CAST(d AS DECIMAL(38,6)), FALSE, 'rd_expense', '2023年', 'parent' FROM n""")
def answer_numbers(spark, sf_dir):
    """Numbers of an answer; a scope stays the nearest words', of which the parent company's weigh most."""
    rows = answers_of(spark, sf_dir).select("k", F.inline(binding.answer_claims(F.col("answer"), F.lit("2024年营业收入是多少"))))
    return rows.select("k", "raw", "number", "unit", "canonical_value", "is_percent", "metric", "period", "scope")


@query(f"""WITH {_NUMBERS}
    SELECT k, CAST(a AS DECIMAL(30,6)) AS number, FALSE is_percent, 'revenue' metric, '2024年' period, '' adjustment FROM n
    UNION ALL SELECT k, CAST(b AS DECIMAL(30,6)), FALSE, 'revenue', '2023年', '' FROM n
    UNION ALL SELECT k, CAST(share AS DECIMAL(30,6)), TRUE, 'revenue', '2024年', '' FROM n
    UNION ALL SELECT k, CAST(c AS DECIMAL(30,6)), FALSE, 'revenue', '2022年', '' FROM n
    UNION ALL SELECT k, CAST(d AS DECIMAL(30,6)), FALSE, 'rd_expense', '2024年', '' FROM n
    UNION ALL SELECT k, CAST(a AS DECIMAL(30,6)), FALSE, 'rd_expense', '2023年', '' FROM n
    UNION ALL SELECT k, CAST(share AS DECIMAL(30,6)), TRUE, 'rd_expense', '2024年', '' FROM n
    UNION ALL SELECT k, CAST(b AS DECIMAL(30,6)), FALSE, 'rd_expense', '2022年', '' FROM n""")
def table_row_numbers(spark, sf_dir):
    """Rows whose label and values stand in lines of their own: columns give periods, the third one shares."""
    lines = [F.lit("主要会计数据"), F.lit("单位：元"), F.lit("2024年 2023年 本年比上年增减(%) 2022年"), F.lit("营业收入"), F.concat_ws(" ", raw("a"), raw("b"), raw("share"), raw("c")), F.lit("研发\n费用"), F.concat_ws(" ", raw("d"), raw("a"), raw("share"), raw("b"))]
    rows = numbers(spark, sf_dir).select("k", F.concat_ws(N, *lines).alias("text"))
    none = F.lit(None).cast("array<string>")
    bound = rows.select("k", F.inline(binding.evidence_claims(F.col("text"), F.lit("2024年营业收入"), F.lit("2024年度"), F.lit("consolidated"), F.lit(True), none)))
    return bound.select("k", "number", "is_percent", "metric", "period", "adjustment")


@query(f"""WITH {_NUMBERS}
    SELECT k, CAST(a AS DECIMAL(30,6)) AS number, '2024年' period, '' adjustment FROM n UNION ALL SELECT k, CAST(b AS DECIMAL(30,6)), '2023年', 'after' FROM n
    UNION ALL SELECT k, CAST(c AS DECIMAL(30,6)), '2023年', 'before' FROM n""")
def adjusted_columns(spark, sf_dir):
    text = F.concat_ws(N, F.lit("主要会计数据"), cells("项目", "2024年", "2023年调整后", "2023年调整前"), cells("营业收入", raw("a"), raw("b"), raw("c")))
    rows = numbers(spark, sf_dir).select("k", text.alias("text"))
    none = F.lit(None).cast("array<string>")
    return rows.select("k", F.inline(binding.evidence_claims(F.col("text"), F.lit("营业收入"), F.lit("2024年度"), F.lit(""), F.lit(True), none))).select("k", "number", "period", "adjustment")


def _claims(spark, sf_dir):
    """Claims against the facts of reports: some of the right value, some of another value, unit, period, scope, metric or kind."""
    n = numbers(spark, sf_dir)
    f = n.select(
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("metric"), F.col("a").cast("decimal(20,6)").alias("value"), F.lit("万元").alias("unit"), F.lit("2024年度").alias("period"),
        F.lit("consolidated").alias("scope"), F.lit(False).alias("is_percent"),
    )
    case = F.col("k") % 7
    c = n.select(
        F.col("k").alias("claim"), F.when(case == 6, F.lit("none")).otherwise(F.concat(F.lit("m"), F.col("k").cast("string"))).alias("metric"),
        F.when(case == 1, F.col("a") + 1).when(case == 2, F.col("a") * 10000).otherwise(F.col("a")).cast("decimal(20,6)").alias("value"), F.when(case == 2, "元").when(case == 5, "%").otherwise("万元").alias("unit"),
        F.when(case == 3, "2023年").otherwise("2024年").alias("period"), F.when(case == 4, "parent").otherwise("unknown").alias("scope"), (case == 5).alias("is_percent"),
    )
    return c, f


@query("""SELECT s_suppkey claim, s_suppkey % 7 IN (0, 2) supported,
          CASE s_suppkey % 7 WHEN 1 THEN 'values differ' WHEN 3 THEN 'periods differ' WHEN 4 THEN 'scopes differ' WHEN 5 THEN 'share against amount' WHEN 6 THEN 'no evidence of the metric' END reason FROM supplier""")
def claim_verdicts(spark, sf_dir):
    c, f = _claims(spark, sf_dir)
    return verify.supported(c, f).join(verify.rejection(c, f), "claim")


@query("""SELECT s_suppkey claim, CASE s_suppkey % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'conflict' WHEN 3 THEN 'supported by text' WHEN 4 THEN 'no evidence' ELSE 'supported by text' END verdict FROM supplier""")
def verified_claims(spark, sf_dir):
    """Facts of the claim's own metric, period and scope come first; two values for one key prove nothing; texts stand in where no fact does."""
    n = numbers(spark, sf_dir).withColumn("i", F.col("k") % 6)
    shape = [F.concat(F.lit("m"), F.col("k").cast("string")).alias("metric"), F.lit("万元").alias("unit"), F.lit("2024年度").alias("period"), F.lit(False).alias("is_percent")]
    right, other = F.col("a").cast("decimal(20,6)"), (F.col("a") + 1).cast("decimal(20,6)")
    scope = F.when(F.col("i") == 5, "parent").otherwise("consolidated")
    claims = n.select(F.col("k").alias("claim"), *shape, F.lit("consolidated").alias("scope"), right.alias("value"))
    facts_ = n.filter("i IN (0, 1, 2, 5)").select(*shape, scope.alias("scope"), F.when(F.col("i") == 1, other).otherwise(right).alias("value"))
    facts_ = facts_.unionByName(n.filter("i = 2").select(*shape, scope.alias("scope"), other.alias("value")))
    told = n.filter("i IN (1, 3, 5)").select(*shape, F.lit("unknown").alias("scope"), right.alias("value"))
    return verify.verified(claims, facts_, told)


@query("""SELECT s_suppkey page, 0 row_no, '项目 | 2024年' line FROM supplier UNION ALL SELECT s_suppkey, 1, '营业 收入 | ' || s_suppkey FROM supplier""")
def recognised_rows(spark, sf_dir):
    """Boxes of a page in reading order: rows by gaps in y, cells by gaps in x."""
    from ..sources import readers

    boxes = [(10.0, 100.0, "项目"), (300.0, 104.0, "2024年"), (10.0, 140.0, "营业"), (55.0, 141.0, "收入"), (300.0, 143.0, None)]
    each = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), (F.lit(t) if t else F.col("k").cast("string")).alias("text")) for x, y, t in boxes])
    rows = numbers(spark, sf_dir).select(F.col("k").alias("page"), F.inline(each)).withColumn("width", F.lit(40.0)).withColumn("height", F.lit(12.0)).withColumn("page_width", F.lit(600.0))
    return readers.layout_rows(rows).select("page", F.col("row_no").cast("int").alias("row_no"), "line")


@query("""
    SELECT s_suppkey line, '' question, 'no question' reason FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, '', 'no answer' FROM supplier WHERE s_suppkey % 4 = 1
    UNION ALL SELECT NULL, 'q' || s_suppkey || ': a|b' || s_suppkey, '' FROM supplier WHERE s_suppkey % 4 > 1""")
def faq_entries(spark, sf_dir):
    """Rows of a list of questions: good ones with their other wordings, bad ones with the reason."""
    from ..sources import readers

    s = F.col("k").cast("string")
    raw = numbers(spark, sf_dir).select(
        F.col("k").alias("line"), F.when(F.col("k") % 4 == 0, "  ").otherwise(F.concat(F.lit(" q"), s)).alias("question"), F.when(F.col("k") % 4 == 1, None).otherwise(F.lit("yes")).alias("answer"),
        F.concat(F.lit("a； b"), s, F.lit(" ,a;")).alias("similar"),
    )
    good, bad = readers.faq_rows(raw)
    return bad.select("line", F.lit("").alias("question"), "reason").unionByName(good.select(F.lit(None).cast("long").alias("line"), F.concat("question", F.lit(": "), F.array_join("similar", "|")).alias("question"), F.lit("").alias("reason")))


@query("""
    SELECT s_suppkey doc, 0 block_no, '甲' section_path, 'first ' || s_suppkey text FROM supplier
    UNION ALL SELECT s_suppkey, 1, '甲 > 一、概况', 'second' || chr(10) || 'line' FROM supplier
    UNION ALL SELECT s_suppkey, 2, '甲 > 二、其他', 'third' FROM supplier
    UNION ALL SELECT s_suppkey, 3, '乙', 'last' FROM supplier""")
def heading_blocks(spark, sf_dir):
    text = F.concat(F.lit("# 甲\nfirst "), F.col("k").cast("string"), F.lit("\n## 一、概况\nsecond\nline\n二、其他\nthird\n# 乙\nlast"))
    return chunking.sections(numbers(spark, sf_dir).select(F.col("k").alias("doc_id"), text.alias("text")), "doc_id")


def _blocks(spark, sf_dir) -> DataFrame:
    """A statement over three pages, a sentence, and another statement: (doc, block_no, page, section_path, text, doc_period)."""
    texts = [
        (1, "甲", F.concat(F.lit("合并利润表\n单位：万元\n项目 本期 上期\n营业收入 "), raw("a"), F.lit(" "), raw("b"))),
        (2, "甲", F.concat(F.lit("研发费用 "), raw("c"), F.lit(" "), raw("d"), F.lit("\n营业收入 "), raw("c"), F.lit(" "), raw("d"))),
        (3, "甲", F.lit("以上数据未经审计。")),
        (3, "甲", F.concat(F.lit("研发费用 "), raw("a"), F.lit(" "), raw("b"), F.lit("\n营业收入 "), raw("a"), F.lit(" "), raw("b"))),
        (4, "乙", F.concat(F.lit("资产负债表\n单位：元\n项目 期末\n营业收入 "), raw("a"))),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("block_no"), F.lit(p).alias("page"), F.lit(s).alias("section_path"), t.alias("text")) for i, (p, s, t) in enumerate(texts)])
    return numbers(spark, sf_dir).select(F.col("k").alias("doc"), F.inline(each)).withColumn("doc_period", F.lit("2024年度"))


_BLOCKS = """
    b AS (SELECT s_suppkey doc, unnest([
        {'block_no': 0, 'table_name': '合并利润表', 'statement_scope': 'consolidated', 'report_period': '2024年度', 'unit': '万元', 'table_id': 'table-0', 'is_table': TRUE},
        {'block_no': 1, 'table_name': '合并利润表', 'statement_scope': 'consolidated', 'report_period': '2024年度', 'unit': '万元', 'table_id': 'table-0', 'is_table': TRUE},
        {'block_no': 2, 'table_name': '', 'statement_scope': 'unknown', 'report_period': '', 'unit': '', 'table_id': '', 'is_table': FALSE},
        {'block_no': 3, 'table_name': '', 'statement_scope': 'unknown', 'report_period': '', 'unit': '', 'table_id': '', 'is_table': FALSE},
        {'block_no': 4, 'table_name': '资产负债表', 'statement_scope': 'unknown', 'report_period': '2024年度', 'unit': '元', 'table_id': 'table-1', 'is_table': TRUE}], recursive := true) FROM supplier)"""


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def table_contexts(spark, sf_dir):
    return blocks.annotated(_blocks(spark, sf_dir)).select("doc", "block_no", "table_name", "statement_scope", "report_period", "unit", "table_id", "is_table")


@query("""SELECT s_suppkey doc, unnest([{'chunk_index': 0, 'section_path': '甲', 'page_start': 1, 'page_end': 3, 'table_id': 'table-0'}, {'chunk_index': 1, 'section_path': '乙', 'page_start': 4, 'page_end': 4, 'table_id': 'table-1'}], recursive := true) FROM supplier""")
def merged_chunks(spark, sf_dir):
    """Blocks that fit together make one chunk, but for those of two tables."""
    return blocks.flat_chunks(blocks.annotated(_blocks(spark, sf_dir))).select("doc", "chunk_index", "section_path", "page_start", "page_end", "table_id")


@query("""
    WITH g AS (SELECT s_suppkey doc, unnest([1, 2, 3]) g FROM supplier)
    SELECT doc, kind, doc || '-p-' || g || '-0' parent, 0 n FROM g, (SELECT unnest(['parent', 'child']) kind)""")
def parents_and_children(spark, sf_dir):
    """Neighbours of one section and table share a parent; each is short enough to have one child."""
    return blocks.parent_child(blocks.annotated(_blocks(spark, sf_dir))).select("doc", "kind", "parent", "n")


@query("""SELECT 'c' || a.s_suppkey asked, 'c' || b.s_suppkey chunk FROM supplier a JOIN supplier b ON a.s_suppkey // 4 = b.s_suppkey // 4
          UNION ALL SELECT 'c' || s_suppkey, 'p' || s_suppkey // 4 FROM supplier""")
def related_chunks(spark, sf_dir):
    k = F.col("k").cast("string")
    parent = F.concat(F.lit("p"), F.floor(F.col("k") / 4).cast("string"))
    rows = numbers(spark, sf_dir).select(F.concat(F.lit("c"), k).alias("chunk"), parent.alias("parent"))
    return blocks.related(rows, rows.select("chunk"))


def _corpus(spark, sf_dir) -> DataFrame:
    """Four chunks a supplier: a table of the year, one of the year before, a table without figures, a cause."""
    n = numbers(spark, sf_dir)
    rows = [
        ("t", True, "2024年度", F.concat(F.lit("| 营业收入 | "), raw("a"), F.lit(" |"))), ("o", True, "2023年度", F.concat(F.lit("| 营业收入 | "), raw("b"), F.lit(" |"))),
        ("h", True, "2024年度", F.lit("| 项目 | 说明 |")), ("c", False, "2024年度", F.concat(F.lit("营业收入变动原因说明：由于销量，增加 "), raw("a"), F.lit(" 元"))),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(t).alias("is_table"), F.lit(p).alias("report_period"), x.alias("text")) for i, (c, t, p, x) in enumerate(rows)])
    doc = F.concat(F.lit("d"), F.col("k").cast("string"))
    return n.select("k", doc.alias("doc"), F.inline(each)).select(
        F.concat("doc", "c").alias("chunk"), "doc", (F.col("k") * 4 + F.col("i")).alias("n"), F.lit("公司2024年年度报告").alias("title"), "text", "is_table", "report_period",
        F.lit("主要会计数据").alias("section_path"), F.lit("").alias("table_name"), F.lit("consolidated").alias("statement_scope"), F.when(F.col("is_table"), F.array(F.lit("营业收入"))).otherwise(F.array().cast("array<string>")).alias("metrics"),
    )


@query("""
    WITH r AS (SELECT s_suppkey query, s_suppkey % 4 = 3 why, s_suppkey % 4 <> 2 locked FROM supplier WHERE s_suppkey % 10 < 4)
    SELECT query, 'd' || query || 't' chunk, CAST(CASE WHEN why THEN 2 ELSE 1 END AS INTEGER) "rank", 'route' source FROM r WHERE locked AND NOT why
    UNION ALL SELECT query, 'd' || query || 'c', 0, 'route' FROM r WHERE locked AND why
    UNION ALL SELECT query, 'd' || query || 't', 1, 'route' FROM r WHERE locked AND why
    UNION ALL SELECT query, 'd' || query || 'c', 0, 'kept' FROM r WHERE locked AND NOT why
    UNION ALL SELECT query, 'd' || query || 'c', 0, 'search' FROM r WHERE NOT locked
    UNION ALL SELECT query, 'x', CAST(CASE WHEN locked THEN 2 ELSE 1 END AS INTEGER), 'search' FROM r""")
def structured_route(spark, sf_dir):
    """Questions of a year's revenue, or of its causes, with the company's documents locked for most: the year's table in front, a cause before it."""
    q = numbers(spark, sf_dir).filter("k % 10 < 4").select(F.col("k").alias("query"), F.when(F.col("k") % 4 == 3, "公司2024年营业收入变动原因").otherwise("公司2024年营业收入是多少").alias("text"))
    locked = q.filter("query % 4 <> 2").select("query", F.concat(F.lit("d"), F.col("query").cast("string")).alias("doc"))
    own = F.concat(F.lit("d"), F.col("query").cast("string"), F.lit("c"))
    found = F.when(F.col("query") % 4 == 3, F.array(F.lit("x"))).otherwise(F.array(own, F.lit("x")))
    hits = q.select("query", F.posexplode(found).alias("rank", "chunk"))
    return route.routed(hits, route.pools(q, _corpus(spark, sf_dir), locked))


@query("""
    WITH c AS (SELECT s_suppkey k, s_suppkey % 5 i FROM supplier)
    SELECT k query, 'd' || k doc FROM c WHERE i IN (0, 1) UNION ALL SELECT k, 'd' || k FROM c WHERE i = 2""")
def locked_documents(spark, sf_dir):
    """The strongest clue that matches locks documents; clues that name two companies lock none."""
    n = numbers(spark, sf_dir).select("k", (F.col("k") % 5).alias("i"), F.col("k").cast("string").alias("s"))
    name = F.struct(F.lit(1).alias("kind"), F.concat(F.lit("name"), F.col("s")).alias("value"))
    code = F.struct(F.lit(0).alias("kind"), F.concat(F.lit("code"), F.col("s")).alias("value"))
    # the company before, which is there for all that ask for it
    other = F.struct(F.lit(1).alias("kind"), F.concat(F.lit("name"), (F.col("k") - 1).cast("string")).alias("value"))
    none = F.struct(F.lit(1).alias("kind"), F.lit("nobody").alias("value"))
    said = F.when(F.col("i") == 0, F.array(name)).when(F.col("i") == 1, F.array(code)).when(F.col("i") == 2, F.array(code, other)).when(F.col("i") == 3, F.array(name, other)).otherwise(F.array(none))
    clues = n.select(F.col("k").alias("query"), F.inline(said))
    both = F.array(name, code)
    markers = n.select(F.concat(F.lit("d"), F.col("s")).alias("doc"), F.concat(F.lit("id"), F.col("s")).alias("identity"), F.inline(both))
    return retrieval.locked_docs(clues, markers)


@query(f"""WITH {_NUMBERS} SELECT k, regexp_replace(regexp_replace(CAST(a AS VARCHAR), '0+$', ''), '[.]$', '') plain FROM n""")
def plain_decimals(spark, sf_dir):
    return numbers(spark, sf_dir).select("k", decimal_text(F.col("a")).alias("plain"))
