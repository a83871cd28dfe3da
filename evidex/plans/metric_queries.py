"""Metric analytics: nations stand for companies, years for periods, sums over order lines for metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from .registry import query, table


def records(spark, sf_dir) -> DataFrame:
    """Metric records: one per nation, year, order status and metric, so that a key may have three."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *[F.col(c).cast("decimal(14,2)").alias(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity")])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    price, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy("n_name", "n_nationkey", F.year("o_orderdate").alias("period_year"), "o_orderstatus").agg(
        F.max("o_orderdate").alias("updated_at"), F.sum(net).alias("revenue"), (F.sum(net) - F.sum(price * F.col("l_tax"))).alias("net_profit_parent"),
        F.sum(price).alias("operating_cash_flow"), F.sum("l_quantity").alias("total_assets"), F.count("*").alias("total_liabilities"),
    )
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("decimal(20,6)").alias("value")) for m in metrics.METRICS])
    p = F.col("o_orderstatus") == "P"
    hidden = (F.col("entity") == "NATION_5") & (F.col("period_year") == 1997) & (F.col("metric") == "total_assets")
    rows = sums.select(
        F.col("n_name").alias("entity"), "period_year", F.lit("annual").alias("period_type"), F.when(p, "parent").otherwise("consolidated").alias("scope"),
        F.when(p & (F.col("n_nationkey") % 7 == 3), "conflict").otherwise("ok").alias("status"), "updated_at", (F.col("n_nationkey") * 100 + F.ascii("o_orderstatus")).cast("long").alias("id"), F.inline(each),
    )
    return rows.withColumn("value", F.when(~hidden, F.col("value")))


_PRICE, _NET = "CAST(l_extendedprice AS DECIMAL(14,2))", "CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(14,2)))"
RECORDS = f"""
    sums AS (SELECT n_name entity, n_nationkey, CAST(year(o_orderdate) AS INTEGER) period_year, o_orderstatus, max(o_orderdate) updated_at,
                    sum({_NET}) revenue, sum({_NET}) - sum({_PRICE} * CAST(l_tax AS DECIMAL(14,2))) net_profit_parent, sum({_PRICE}) operating_cash_flow,
                    sum(CAST(l_quantity AS DECIMAL(14,2))) total_assets, count(*) total_liabilities
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             GROUP BY ALL),
    wide AS ({" UNION ALL ".join(f"SELECT *, '{m}' metric, CAST({m} AS DECIMAL(20,6)) v FROM sums" for m in metrics.METRICS)}),
    records AS (SELECT entity, period_year, 'annual' period_type, CASE WHEN o_orderstatus = 'P' THEN 'parent' ELSE 'consolidated' END AS scope,
                       CASE WHEN o_orderstatus = 'P' AND n_nationkey % 7 = 3 THEN 'conflict' ELSE 'ok' END status, updated_at,
                       CAST(n_nationkey * 100 + ascii(o_orderstatus) AS BIGINT) id, metric,
                       CASE WHEN NOT (entity = 'NATION_5' AND period_year = 1997 AND metric = 'total_assets') THEN v END AS value FROM wide),
    latest AS (SELECT *, count(*) OVER k > 1 AS duplicate, row_number() OVER (PARTITION BY entity, period_year, metric ORDER BY updated_at DESC, id DESC) rn FROM records
               WINDOW k AS (PARTITION BY entity, period_year, metric)),
    best AS (SELECT * EXCLUDE (rn) FROM latest WHERE rn = 1)"""
_KEY = "entity, period_year, metric"


@query(f"WITH {RECORDS} SELECT entity, period_year, metric, value, scope, status, id, duplicate FROM best")
def latest_metric_record(spark, sf_dir):
    return metrics.latest(records(spark, sf_dir)).select("entity", "period_year", "metric", "value", "scope", "status", "id", "duplicate")


@query(f"""WITH {RECORDS} SELECT entity, period_year, {", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in metrics.METRICS)} FROM best GROUP BY entity, period_year""")
def metric_pivot(spark, sf_dir):
    return metrics.pivoted(metrics.latest(records(spark, sf_dir)))


_COMPARED = f"""{RECORDS},
    paired AS (SELECT c.*, p.value prev_value, p.period_type prev_type, p.scope prev_scope, p.entity IS NOT NULL found
             FROM best c LEFT JOIN best p ON c.entity = p.entity AND c.metric = p.metric AND c.period_year = p.period_year + 1),
    noted AS (SELECT *, CASE WHEN NOT found THEN 'no comparison record' WHEN period_type <> prev_type THEN 'period types differ' WHEN scope <> prev_scope THEN 'scopes differ'
                             WHEN value IS NULL OR prev_value IS NULL THEN 'a value is missing' END why FROM paired)"""


_YOY = f"""{_COMPARED},
    yoy AS (SELECT {_KEY}, value, prev_value, why IS NULL comparable, CASE WHEN why IS NULL THEN CAST(value - prev_value AS DECIMAL(20,6)) END change_amount,
           CASE WHEN why IS NULL AND prev_value <> 0 THEN CAST(round(CAST((CAST(value AS DOUBLE) - CAST(prev_value AS DOUBLE)) / abs(CAST(prev_value AS DOUBLE)) * 100 AS DECIMAL(30,10)), 2) AS DECIMAL(20,2)) END change_rate,
           CASE WHEN why IS NOT NULL THEN why WHEN prev_value = 0 THEN 'the comparison value is zero' ELSE 'compared' END note
    FROM noted)"""


@query(f"WITH {_YOY} SELECT * FROM yoy")
def company_yoy(spark, sf_dir):
    return metrics.compared(records(spark, sf_dir))


_RELATED = """
    wide_best AS (SELECT entity, period_year, max(value) FILTER (WHERE metric = 'net_profit_parent') l, max(value) FILTER (WHERE metric = 'operating_cash_flow') r FROM best GROUP BY ALL),
    related AS (SELECT entity, period_year, l left_value, r right_value, CAST(r - l AS DECIMAL(20,6)) difference,
           CASE WHEN r > l THEN 'higher' WHEN r < l THEN 'lower' WHEN r = l THEN 'equal' ELSE 'unavailable' END relation FROM wide_best)"""


@query(f"WITH {RECORDS}, {_RELATED} SELECT * FROM related")
def profit_cash_relation(spark, sf_dir):
    return metrics.relation(metrics.pivoted(metrics.latest(records(spark, sf_dir))))


_PEERS = f"""{RECORDS}, g AS (SELECT n_name entity, n_regionkey grp FROM nation),
    wanted AS (SELECT DISTINCT g.grp, period_year FROM best JOIN g ON g.entity = best.entity),
    grid AS (SELECT w.grp, w.period_year, g.entity, m.metric FROM wanted w JOIN g ON g.grp = w.grp, (SELECT unnest([{", ".join(f"'{m}'" for m in metrics.METRICS)}]) metric) m),
    j AS (SELECT grid.*, b.value, b.status, b.period_type, b.scope FROM grid LEFT JOIN best b ON b.entity = grid.entity AND b.period_year = grid.period_year AND b.metric = grid.metric),
    n AS (SELECT *, CASE WHEN bool_or(value IS NULL) OVER k THEN 'missing' WHEN bool_or(coalesce(status IN ('conflict', 'failed'), false)) OVER k THEN 'conflict'
                         WHEN coalesce(min(period_type) OVER k <> max(period_type) OVER k, false) THEN 'period types differ'
                         WHEN coalesce(min(scope) OVER k <> max(scope) OVER k, false) THEN 'scopes differ' ELSE 'comparable' END note,
                 max(abs(value)) OVER k most, max(value) OVER k hi, min(value) OVER k lo FROM j WINDOW k AS (PARTITION BY grp, period_year, metric)),
    peers AS (SELECT grp, period_year, metric, entity, value, note = 'comparable' comparable, note,
           CASE WHEN note = 'comparable' THEN CAST(CASE WHEN most = 0 THEN 0 ELSE round(CAST(CAST(abs(value) AS DOUBLE) / CAST(most AS DOUBLE) * 100 AS DECIMAL(30,10)), 2) END AS DECIMAL(20,2)) END bar_percent,
           CASE WHEN note = 'comparable' THEN value = hi END leader, CASE WHEN note = 'comparable' THEN value = lo END laggard,
           CASE WHEN note = 'comparable' THEN CAST(hi - lo AS DECIMAL(20,6)) END spread FROM n)"""


@query(f"WITH {_PEERS} SELECT * FROM peers")
def peer_comparison(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("entity"))
    return metrics.peers(records(spark, sf_dir), groups)


_FINDINGS = f"""
    y AS (SELECT DISTINCT entity, period_year FROM best),
    grid AS (SELECT entity, period_year, metric FROM y, (SELECT unnest([{", ".join(f"'{m}'" for m in metrics.METRICS)}]) metric)),
    j AS (SELECT g.*, c.value, c.period_type, c.scope, c.duplicate, c.entity IS NOT NULL f, p.value pv, p.period_type pt, p.scope ps, p.entity IS NOT NULL pf FROM grid g
          LEFT JOIN best c ON c.entity = g.entity AND c.period_year = g.period_year AND c.metric = g.metric
          LEFT JOIN best p ON p.entity = g.entity AND p.period_year + 1 = g.period_year AND p.metric = g.metric),
    findings AS (SELECT {_KEY}, 'duplicate_metric' code FROM j WHERE duplicate
    UNION ALL SELECT {_KEY}, 'missing_current_metric' FROM j WHERE NOT f
    UNION ALL SELECT {_KEY}, 'missing_current_value' FROM j WHERE f AND value IS NULL
    UNION ALL SELECT {_KEY}, 'missing_comparison_metric' FROM j WHERE NOT pf
    UNION ALL SELECT {_KEY}, 'missing_comparison_value' FROM j WHERE pf AND pv IS NULL
    UNION ALL SELECT {_KEY}, 'period_type_mismatch' FROM j WHERE f AND pf AND period_type <> pt
    UNION ALL SELECT {_KEY}, 'statement_scope_mismatch' FROM j WHERE f AND pf AND period_type = pt AND scope <> ps
    UNION ALL SELECT {_KEY}, 'zero_comparison_base' FROM j WHERE f AND pf AND period_type = pt AND scope = ps AND value IS NOT NULL AND pv = 0)"""


@query(f"WITH {RECORDS}, {_FINDINGS} SELECT * FROM findings")
def pending_items(spark, sf_dir):
    return metrics.findings(records(spark, sf_dir))


@query("""
    WITH m AS (SELECT o_orderkey id, o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL)
    SELECT *, (SELECT count(*) FROM m) total FROM m ORDER BY id DESC LIMIT 50 OFFSET 100""")
def metric_list_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return metrics.page(rows, (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isNotNull(), 50, 100).drop("o_orderstatus")


@query("SELECT DISTINCT c_mktsegment AS company FROM customer")
def distinct_companies(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("company")).distinct()


@query("""
    WITH stored AS (SELECT s_suppkey k, s_nationkey n, 'stored' origin FROM supplier WHERE s_acctbal >= 0),
         seed AS (SELECT s_suppkey k, s_nationkey n, 'seed' origin FROM supplier)
    SELECT * FROM stored UNION ALL SELECT * FROM seed WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE t.k = seed.k AND t.n = seed.n)""")
def seed_missing(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), "s_acctbal")
    stored = s.filter("s_acctbal >= 0").select("k", "n", F.lit("stored").alias("origin"))
    return metrics.seeded(stored, s.select("k", "n", F.lit("seed").alias("origin")), ("k", "n"))


@query("""
    WITH p AS (SELECT c_custkey id, c_mktsegment seg, round(c_acctbal, 0) bal FROM customer),
         s AS (SELECT c_custkey id, c_mktsegment seg, c_acctbal bal FROM customer)
    SELECT s.id, s.seg AS old_seg, coalesce(p.seg, s.seg) AS new_seg, s.bal old_bal, coalesce(p.bal, s.bal) new_bal FROM s LEFT JOIN p ON p.id = s.id WHERE coalesce(p.bal, s.bal) <> s.bal""")
def metric_revisions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    # SQL's round() keeps the sign of what becomes zero
    whole = F.when(F.col("bal") < 0, -F.round(-F.col("bal"), 0)).otherwise(F.round("bal", 0))
    _, changes = metrics.patched(s, s.withColumn("bal", whole))
    shape = "seg string, bal double"
    rows = changes.select("id", F.from_json("old_snapshot", shape).alias("o"), F.from_json("new_snapshot", shape).alias("n"))
    return rows.select("id", F.col("o.seg").alias("old_seg"), F.col("n.seg").alias("new_seg"), F.col("o.bal").alias("old_bal"), F.col("n.bal").alias("new_bal"))


def _cell(c: str) -> str:
    return f"replace(replace(coalesce(CAST({c} AS VARCHAR), '—'), '|', chr(92) || '|'), chr(10), '<br>')"


@query(f"""WITH {_YOY}
    SELECT entity, period_year, '| metric | value | before | change | rate | note |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10)
           || string_agg('| ' || {" || ' | ' || ".join(_cell(c) for c in ("metric", "value", "prev_value", "change_amount", "change_rate", "note"))} || ' |', chr(10) ORDER BY metric) markdown
    FROM yoy GROUP BY entity, period_year""")
def company_export(spark, sf_dir):
    return metrics.company_markdown(metrics.compared(records(spark, sf_dir)))


@query(f"""WITH {_YOY}, {_RELATED}, {_FINDINGS},
    m AS (SELECT entity, period_year, string_agg(line, chr(10) ORDER BY line) metrics FROM (SELECT entity, period_year, '- **' || metric || '**: ' || coalesce(CAST(value AS VARCHAR), '—') || ' (' || note || ')' line FROM yoy) GROUP BY ALL),
    t AS (SELECT entity, period_year, string_agg(line, chr(10) ORDER BY line) todo FROM (SELECT entity, period_year, '- ' || metric || ': ' || code line FROM findings) GROUP BY ALL)
    SELECT m.entity, m.period_year, '# Company brief' || chr(10) || chr(10) || '## ' || m.entity || ' ' || m.period_year || chr(10) || chr(10) || metrics || chr(10) || chr(10) || '## Profit and cash flow' || chr(10) || chr(10) || '- '
           || coalesce(relation, 'unavailable') || chr(10) || chr(10) || '## To be checked' || chr(10) || chr(10) || coalesce(todo, '- none') || chr(10) brief
    FROM m LEFT JOIN related r ON r.entity = m.entity AND r.period_year = m.period_year LEFT JOIN t ON t.entity = m.entity AND t.period_year = m.period_year""")
def company_briefs(spark, sf_dir):
    rows = records(spark, sf_dir)
    return metrics.company_brief(metrics.compared(rows), metrics.relation(metrics.pivoted(metrics.latest(rows))), metrics.findings(rows))


@query(f"""WITH {_PEERS},
    s AS (SELECT grp, period_year, metric, any_value(comparable) c, any_value(note) note, any_value(spread) spread, string_agg(entity, ', ' ORDER BY entity) FILTER (WHERE leader) high, string_agg(entity, ', ' ORDER BY entity) FILTER (WHERE laggard) low FROM peers GROUP BY ALL)
    SELECT grp, period_year, metric, CASE WHEN NOT c THEN 'not comparable: ' || note WHEN spread = 0 THEN high || ': equal' ELSE high || ' above ' || low || ' by ' || CAST(spread AS VARCHAR) END line FROM s""")
def peer_briefs(spark, sf_dir):
    return metrics.peer_brief(peer_comparison(spark, sf_dir))


_ORDER = "CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(metrics.METRICS)) + " END"


@query(f"""WITH {RECORDS} SELECT entity, period_year, string_agg(metric || '@' || 'report ' || id || ':' || (id % 90 + 1), ' ' ORDER BY {_ORDER}) sources FROM best GROUP BY entity, period_year""")
def metric_disclosures(spark, sf_dir):
    """Where each present metric's latest record is from."""
    rows = records(spark, sf_dir)
    rows = rows.withColumn("source_title", F.concat(F.lit("report "), F.col("id").cast("string"))).withColumn("source_page", F.col("id") % 90 + 1).withColumn("source_page_end", F.lit(None).cast("long")).withColumn("source_text", F.lit(None).cast("string"))
    told = F.transform("disclosures", lambda d: F.concat(d["metric"], F.lit("@"), d["source_title"], F.lit(":"), d["source_page"].cast("string")))
    return metrics.disclosures(rows).select("entity", "period_year", F.array_join(told, " ").alias("sources"))


@query(f"""WITH {_YOY}, {_RELATED}, {_FINDINGS},
    f AS (SELECT entity, period_year, count(*) n FROM findings GROUP BY ALL), d AS (SELECT entity, period_year, count(*) n FROM best GROUP BY ALL)
    SELECT y.entity, y.period_year, count(*) n_metrics, any_value(r.relation) relation, any_value(d.n) n_disclosures, coalesce(any_value(f.n), 0) n_pending
    FROM yoy y JOIN related r ON r.entity = y.entity AND r.period_year = y.period_year LEFT JOIN d ON d.entity = y.entity AND d.period_year = y.period_year LEFT JOIN f ON f.entity = y.entity AND f.period_year = y.period_year GROUP BY ALL""")
def company_analysis(spark, sf_dir):
    rows = records(spark, sf_dir)
    for c, t in (("source_title", "string"), ("source_page", "long"), ("source_page_end", "long"), ("source_text", "string")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    size = {"n_metrics": "metrics", "n_disclosures": "disclosures", "n_pending": "pending"}
    return metrics.analysed(rows).select("entity", "period_year", "profit_cash_flow.relation", *[F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for n, c in size.items()])


@query(f"""WITH {RECORDS},
    p AS (SELECT entity, report, period_year FROM best, (SELECT unnest(['年度', '年']) suffix), LATERAL (SELECT period_year || suffix report) WHERE metric = 'revenue' AND (suffix = '年度' OR period_year % 2 = 0))
    SELECT entity, '1997年度' report_period FROM p WHERE report = '1997年度'""")
def first_period_found(spark, sf_dir):
    """Of the spellings of a year each entity's first that has records counts."""
    from ..operators import company

    rows = metrics.latest(records(spark, sf_dir)).filter("metric = 'revenue'").select("entity", F.col("period_year").cast("string").alias("y"))
    both = rows.select("entity", F.concat("y", F.lit("年度")).alias("report_period")).unionByName(rows.filter("y % 2 = 0").select("entity", F.concat("y", F.lit("年")).alias("report_period")))
    return company.first_period(both, "1997 年").select("entity", "report_period")


@query("""
    WITH k AS (SELECT DISTINCT n_name company FROM nation), a AS (SELECT unnest(['NATION_1', 'nation_24', 'NATION_', 'nowhere', 'NATION_7 LTD']) asked),
         p AS (SELECT asked, company FROM a JOIN k ON contains(lower(company), lower(asked)) OR contains(lower(asked), lower(company)))
    SELECT a.asked, coalesce(max(CASE WHEN a.asked = company THEN company END), CASE WHEN count(company) = 1 THEN any_value(company) END, '') company, count(company) n_candidates FROM a LEFT JOIN p ON p.asked = a.asked GROUP BY a.asked""")
def companies_resolved(spark, sf_dir):
    """A name is its company, else the only one that holds it or is held by it."""
    from ..operators import company, ops

    asked = ops.rows(spark, [(x,) for x in ("NATION_1", "nation_24", "NATION_", "nowhere", "NATION_7 LTD")], "asked")
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"))
    return company.resolved(asked, known).select("asked", "company", F.size("candidates").cast("long").alias("n_candidates"))
