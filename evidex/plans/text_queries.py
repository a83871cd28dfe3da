"""Chunking, hashing, redaction and numbers over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, ops, retrieval
from ..tables import spread
from .registry import query, table


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("""SELECT doc_id doc, CAST(i / 700 AS INTEGER) chunk_index, substring(text, i + 1, 800) text FROM (SELECT doc_id, text, unnest(range(0, length(text), 700)) i FROM documents)""".replace("i / 700", "i // 700"))
def chunk_fixed_windows(spark, sf_dir):
    return chunking.chunks(documents(spark, sf_dir), chunking.windows(F.col("text"))).select("doc", "chunk_index", "text")


@query("""
    WITH RECURSIVE u AS (SELECT doc_id doc, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') u FROM documents),
    s AS (SELECT doc, u, 0 i, CAST([] AS VARCHAR[]) done, '' AS now FROM u
          UNION ALL SELECT doc, u, i + 1,
                 CASE WHEN length(x) > 800 THEN (CASE WHEN now <> '' THEN list_append(done, now) ELSE done END) || list_transform(range(0, length(x), 700), lambda p: substring(x, p + 1, 800)) WHEN full_ THEN list_append(done, now) ELSE done END,
                 CASE WHEN length(x) > 800 THEN '' WHEN full_ OR now = '' THEN x ELSE now || chr(10) || chr(10) || x END
          FROM (SELECT *, u[i + 1] x, now <> '' AND length(now) + length(u[i + 1]) + 2 > 800 full_ FROM s WHERE i < len(u))),
    c AS (SELECT doc, CASE WHEN now <> '' THEN list_append(done, now) ELSE done END c FROM s WHERE i = len(u)),
    n AS (SELECT doc, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) chunk_index, unnest(c) text, len(c) n FROM c)
    SELECT doc, chunk_index, text, CASE WHEN chunk_index > 0 THEN doc || '-' || chunk_index - 1 END previous_chunk, CASE WHEN chunk_index + 1 < n THEN doc || '-' || chunk_index + 1 END next_chunk FROM n""")
def chunk_greedy(spark, sf_dir):
    """Whole lines packed greedily: these documents have no blank lines, so a line is the unit."""
    return chunking.chunks(spread(documents(spark, sf_dir)), chunking.packed(F.col("text"), separator="\\n")).select("doc", "chunk_index", "text", "previous_chunk", "next_chunk")


_LEVEL = """CASE WHEN regexp_full_match(t, '[0-9.,%\\s]*') THEN 0 WHEN regexp_matches(t, '^#{1,6}\\s+\\S') THEN length(regexp_extract(t, '^#+')) WHEN regexp_matches(t, '^第[一二三四五六七八九十百0-9]+[章节条]')
    THEN CASE WHEN regexp_matches(t, '^第[^章节条]+章') THEN 1 WHEN regexp_matches(t, '^第[^章节条]+节') THEN 2 ELSE 3 END WHEN length(t) > 50 THEN 0
    WHEN regexp_matches(t, '^[一二三四五六七八九十]+、') THEN 2 WHEN regexp_matches(t, '^[0-9]+[.][0-9]+\\s*\\S') THEN 4 WHEN regexp_matches(t, '^[0-9]+[.、]\\s*\\S') THEN 3 ELSE 0 END"""


@query(f"""
    WITH RECURSIVE l AS (SELECT doc_id doc, generate_subscripts(x, 1) i, unnest(x) line FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents)),
    m AS (SELECT doc, i, line, {_LEVEL} lv FROM (SELECT *, trim(line) t FROM l)),
    g AS (SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING) h FROM m),
    hs AS (SELECT doc, list(lv ORDER BY i) lvs, list(trim(regexp_replace(line, '^\\s*#{{1,6}}\\s+', '')) ORDER BY i) titles FROM m WHERE lv > 0 GROUP BY doc),
    s AS (SELECT doc, 0 h, CAST([] AS VARCHAR[]) stack, lvs, titles FROM hs UNION ALL SELECT doc, h + 1, list_append(list_resize(stack, lvs[h + 1] - 1, ''), titles[h + 1]), lvs, titles FROM s WHERE h < len(lvs)),
    b AS (SELECT doc, h, string_agg(line, chr(10) ORDER BY i) text FROM g WHERE lv = 0 GROUP BY doc, h)
    SELECT b.doc, CAST(row_number() OVER (PARTITION BY b.doc ORDER BY b.h) - 1 AS INTEGER) block_no, coalesce(array_to_string(list_filter(stack, lambda x: x <> ''), ' > '), '') section_path, text
    FROM b LEFT JOIN s ON s.doc = b.doc AND s.h = b.h""")
def section_blocks(spark, sf_dir):
    return chunking.sections(documents(spark, sf_dir))


@query("SELECT source, sha256(text) content_hash, min(doc_id) doc_id, count(*) copies FROM documents GROUP BY source, sha256(text)")
def content_hash_dedupe(spark, sf_dir):
    return ops.first_of_each_hash(documents(spark, sf_dir), "text", ("source",), "doc_id")


@query("""SELECT source, count(*) n_docs, CAST(sum(n_chars) AS BIGINT) n_chars, min(doc_id) first_doc, arg_min(lang, doc_id) first_lang FROM documents GROUP BY source""")
def doc_listing(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"), F.min_by("lang", "doc_id").alias("first_lang"))


@query("""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[邮箱已隐藏]', 'g') text FROM documents""")
def email_redaction(spark, sf_dir):
    pattern, stand_in = text.REDACTIONS[3]
    return documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", pattern, stand_in).alias("text"))


def _redacted(column: str, patterns) -> str:
    """Nested replacements without look-around: what must not stand beside a match is taken and put back, twice, since two matches may share it."""
    for pattern, stand_in in patterns:
        if pattern.startswith("(?<![0-9])"):
            p = f"(^|[^0-9]){pattern.removeprefix('(?<![0-9])').removesuffix('(?![0-9])')}([^0-9]|$)"
            for _ in range(2):
                column = f"regexp_replace({column}, '{p}', '\\1{stand_in}\\2', 'g')"
        else:
            column = f"regexp_replace({column}, '{pattern}', '{stand_in}', 'g')"
    return column


_PERSONAL = " || ' id ' || (11010519491231002 + doc_id) || 'X, card ' || (6222021234567890 + doc_id) || ', mobile ' || (13800000000 + doc_id) || ',' || (13900000000 + doc_id) || ' 1' || (13700000000 + doc_id) || ' sk_abcdefghijklmnop' || doc_id"


@query(f"SELECT doc_id, {_redacted('text' + _PERSONAL, text.REDACTIONS)} text FROM documents")
def pii_redaction(spark, sf_dir):
    """Documents with personal numbers behind them: some to be hidden, one too long for a mobile number."""
    return spread(documents(spark, sf_dir)).select("doc_id", text.redacted(F.expr(f"text{_PERSONAL}")).alias("text"))


@query("""WITH t AS (SELECT lang, unnest(list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), lambda t: length(t) > 1)) term FROM documents)
          SELECT lang, term, count(*) n FROM t GROUP BY ALL""")
def term_frequencies(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("lang", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,6)) v FROM orders)
          SELECT o_orderkey, CAST(v * 10000 AS DECIMAL(30,6)) canonical, round(v, 2)::DECIMAL(20,2) rounded FROM s""")
def unit_scaling(spark, sf_dir):
    v = F.col("o_totalprice").cast("decimal(20,6)")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.canonical(v, F.lit("万元")).alias("canonical"), F.round(v, 2).cast("decimal(20,2)").alias("rounded"))


@query("""
    WITH f AS (SELECT l_partkey metric, year(l_shipdate) period, l_returnflag AS scope, CAST(l_quantity AS DECIMAL(20,6)) v FROM lineitem)
    SELECT metric, period, scope, count(DISTINCT v) n_values FROM f GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def fact_conflicts(spark, sf_dir):
    from ..operators import verify

    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("metric"), F.year("l_shipdate").cast("long").alias("period"), F.col("l_returnflag").alias("scope"), F.col("l_quantity").cast("decimal(20,6)").alias("value"))
    return verify.conflicts(facts)


@query("""
    WITH c AS (SELECT o_orderkey id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice AS DECIMAL(20,6)) + 1 ELSE CAST(o_totalprice AS DECIMAL(20,6)) END v, year(o_orderdate) period FROM orders),
         f AS (SELECT o_orderkey id, CAST(o_totalprice AS DECIMAL(20,6)) v, year(o_orderdate) period FROM orders)
    SELECT c.id, bool_or(coalesce(c.v = f.v AND c.period = f.period, false)) supported FROM c LEFT JOIN f ON f.id = c.id GROUP BY c.id""")
def claims_vs_facts(spark, sf_dir):
    from ..operators import verify

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("metric"), F.col("o_totalprice").cast("decimal(20,6)").alias("value"), F.year("o_orderdate").cast("string").alias("period"))
    facts = o.select("metric", "value", "period", F.lit("元").alias("unit"), F.lit("consolidated").alias("scope"), F.lit(False).alias("is_percent"))
    claims = facts.withColumn("value", F.when(F.col("metric") % 4 == 0, (F.col("value") + 1).cast("decimal(20,6)")).otherwise(F.col("value"))).withColumn("claim", F.col("metric"))
    return verify.supported(claims, facts).select(F.col("claim").alias("id"), "supported")


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _all(words: dict) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {_any(w)} THEN '{g}' END" for g, w in words.items()) + ")"


_ASKED = "text || CASE turn % 4 WHEN 0 THEN '母公司 营业收入是多少' WHEN 1 THEN '研发 费用变动原因，利润表' WHEN 2 THEN '受市场影响的归母净利润' ELSE '' END"


@query(f"""
    WITH q AS (SELECT conv_id, turn, regexp_replace({_ASKED}, '\\s', '', 'g') t FROM conversations),
         p AS (SELECT conv_id, turn, t, {_all(retrieval.METRIC_GROUPS)} AS "groups", CASE WHEN contains(t, '母公司') THEN 'parent' WHEN contains(t, '子公司') THEN 'subsidiary' WHEN contains(t, '合并') THEN 'consolidated' ELSE '' END AS scope,
                      {_any(retrieval.CAUSE_ASKED)} OR regexp_matches(t, '{retrieval.AFFECTED}') is_cause, {_all({s: (s,) for s in retrieval.SECTIONS})} sections FROM q)
    SELECT conv_id, turn, "groups", scope, is_cause, "groups" <> '' OR {_any(retrieval.FINANCIAL)} is_financial, "groups" <> '' AND ({_any(retrieval.NUMERIC)} OR NOT is_cause) is_numeric, sections FROM p""")
def question_profiles(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.profile(F.expr(_ASKED)).alias("p"))
    return p.select("conv_id", "turn", F.array_join("p.groups", "|").alias("groups"), "p.scope", "p.is_cause", "p.is_financial", "p.is_numeric", F.array_join("p.sections", "|").alias("sections"))


# a sign right behind a digit is no sign
_SIGNS = "regexp_replace({}, '([0-9])[+-]([0-9])', '\\1#\\2', 'g')"
_FOUND = f"regexp_extract_all(regexp_replace({_SIGNS.format(_SIGNS.format('text'))}, '\\[[0-9]+\\]', '', 'g'), '[+-]?(?:[0-9]{{1,3}}(?:[, \\t][0-9]{{3}})+|[0-9]+)(?:[.][0-9]+)?[ \\t]*%?')"


@query(f"""
    WITH m AS (SELECT doc_id, trim(unnest({_FOUND})) raw FROM documents),
         n AS (SELECT doc_id, raw, CASE WHEN ends_with(raw, '%') THEN '%' ELSE '' END unit, CAST(regexp_replace(raw, '[, \t%]', '', 'g') AS DECIMAL(30,6)) number FROM m)
    SELECT doc_id, raw, number, unit, CAST(number AS DECIMAL(38,6)) canonical_value, unit = '%' is_percent, '' metric FROM n WHERE NOT (unit = '' AND number = floor(number) AND number BETWEEN 1900 AND 2100)""")
def numeric_claims(spark, sf_dir):
    """Numbers that documents state; these name no metric of the engine's."""
    from ..operators import verify

    return documents(spark, sf_dir).select("doc_id", F.inline(verify.numeric_claims("text"))).select("doc_id", "raw", "number", "unit", "canonical_value", "is_percent", "metric")
