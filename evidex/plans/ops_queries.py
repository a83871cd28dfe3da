"""Operations, governance and evaluation over events, conversations, orders and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import filters
from ..operators import evaluate, ops
from .registry import query, table

AS_OF = "1999-06-30 00:00:00"
EVENTS_AS_OF = "2024-01-20 00:00:00"
KINDS = ("view", "click", "purchase", "signup", "error", "refund")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(f"""SELECT {", ".join(f"count(*) FILTER (WHERE event_type = '{k}') n_{k}" for k in KINDS)}, count(*) total, count(*) FILTER (WHERE value > 90) breaches FROM events""")
def ops_status_counts(spark, sf_dir):
    return ops.status_counts(events(spark, sf_dir).withColumnRenamed("event_type", "status"), KINDS, F.col("value") > 90)


@query("""SELECT count(*) total, count(*) FILTER (WHERE quality = 1) positive, count(*) FILTER (WHERE quality = 0) negative,
                 coalesce(round(count(*) FILTER (WHERE quality = 1) / count(*), 4), 0) satisfaction FROM labels""")
def feedback_stats(spark, sf_dir):
    return ops.feedback_stats(table(spark, sf_dir, "labels"), F.col("quality"))


@query("""SELECT event_type, CAST(round(avg(CAST(value AS DECIMAL(20,6))), 2) AS DOUBLE) avg_value, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) escalate_rate, count(*) n FROM events GROUP BY event_type""")
def rag_stats(spark, sf_dir):
    return ops.rag_stats(events(spark, sf_dir), "event_type", F.col("value"), F.col("value") > 50)


@query("""SELECT event_type, count(*) n, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, max(value) max_value FROM events GROUP BY event_type""")
def latency_percentiles_nearest(spark, sf_dir):
    return ops.percentiles(events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "max_value": 1.0}, floor=False, few=500)


@query("""
    WITH l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 200),
         s AS (SELECT event_type, list_sort(list(value)) v FROM l GROUP BY event_type)
    SELECT event_type, len(v) n, v[CAST(least(len(v) - 1, floor(0.5 * len(v))) AS INTEGER) + 1] p50, v[CAST(least(len(v) - 1, floor(0.95 * len(v))) AS INTEGER) + 1] p95 FROM s""")
def latency_percentiles_floor(spark, sf_dir):
    last = ops.last_of_each(events(spark, sf_dir), "event_type", "event_id", 200)
    return ops.percentiles(last, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""
    WITH load AS (SELECT o_custkey agent, count(*) load FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey),
         a AS (SELECT c_custkey agent, c_nationkey grp, coalesce(load, 0) load FROM customer LEFT JOIN load ON agent = c_custkey WHERE c_acctbal > 0)
    SELECT grp, arg_min(agent, (load, agent)) agent, min(load) load FROM a GROUP BY grp""")
def least_loaded_agent(spark, sf_dir):
    agents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_nationkey").alias("grp"), (F.col("c_acctbal") > 0).alias("available"), F.col("c_custkey").alias("ord"))
    busy = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("agent"))
    return ops.least_loaded(agents, busy)


@query("""
    WITH r AS (SELECT event_type category, ['day' || day(ts), 'user' || user_id % 10] tags, value <= 50 passed FROM events),
         s AS (SELECT 'category' kind, category name, passed FROM r UNION ALL SELECT 'tag', unnest(tags), passed FROM r)
    SELECT kind, name, count(*) total, count(*) FILTER (WHERE passed) n_passed FROM s GROUP BY ALL""")
def category_tag_slices(spark, sf_dir):
    tags = F.array(F.concat(F.lit("day"), F.dayofmonth("ts").cast("string")), F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")))
    return evaluate.slices(events(spark, sf_dir).select(F.col("event_type").alias("category"), tags.alias("tags"), (F.col("value") <= 50).alias("passed")))


@query("""SELECT event_id, 'T' || strftime(ts, '%Y%m%d') || '-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS number
          FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY event_id) n FROM events)""")
def ticket_numbering(spark, sf_dir):
    return ops.numbered(events(spark, sf_dir), F.col("ts"), "event_id").select("event_id", "number")


@query("""SELECT user_id, count(*) n FROM events GROUP BY user_id ORDER BY n DESC, user_id""")
def thread_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id")


@query("""
    WITH stored AS (SELECT 'u' || user_id AS key, 'low' severity, CASE WHEN user_id % 2 = 0 THEN 'resolved' ELSE 'acknowledged' END status FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')),
         emitted AS (SELECT DISTINCT 'u' || user_id AS key, 'high' severity FROM events WHERE event_type = 'error' AND value > 95)
    SELECT coalesce(s.key, e.key) AS key, coalesce(e.severity, s.severity) severity,
           CASE WHEN s.key IS NULL THEN 'open' WHEN e.key IS NOT NULL AND s.status = 'resolved' THEN 'open' ELSE s.status END status
    FROM stored s FULL JOIN emitted e ON s.key = e.key""")
def alert_upsert(spark, sf_dir):
    return ops.alerts_after(*_alerts(spark, sf_dir))


def _alerts(spark, sf_dir):
    e = events(spark, sf_dir)
    key = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key")
    users = e.filter("event_type = 'view'").select("user_id").distinct()
    stored = users.select(key, F.lit("low").alias("severity"), F.when(F.col("user_id") % 2 == 0, "resolved").otherwise("acknowledged").alias("status"))
    return stored, e.filter("event_type = 'error' AND value > 95").select(key, F.lit("high").alias("severity")).distinct()


@query("""
    WITH stored AS (SELECT 'u' || user_id AS key, CASE WHEN user_id % 2 = 0 THEN 'resolved' ELSE 'acknowledged' END status FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')),
         active AS (SELECT DISTINCT 'u' || user_id AS key FROM events WHERE event_type = 'error' AND value > 95)
    SELECT key, CASE WHEN starts_with(key, 'u1') AND key NOT IN (SELECT key FROM active) THEN 'resolved' ELSE status END status FROM stored""")
def alert_resolve_missing(spark, sf_dir):
    stored, active = _alerts(spark, sf_dir)
    return ops.resolved_missing(stored, "u1", active).select("key", "status")


@query("""SELECT key, severity, 'open' status FROM (
        SELECT 'sla' AS key, 'high' severity, b > 0 hit FROM s UNION ALL SELECT 'overdue', 'medium', o > 0 FROM s UNION ALL SELECT 'queue', 'high', w >= 20 FROM s
        UNION ALL SELECT 'faithfulness', 'high', fn >= 10 AND f < 7 FROM s UNION ALL SELECT 'satisfaction', 'medium', qn >= 10 AND q < 0.8 FROM s) WHERE hit""".replace("FROM s", """FROM (
        SELECT count(*) FILTER (WHERE event_type = 'error' AND value > 99) b, count(*) FILTER (WHERE value < 0) o, count(*) FILTER (WHERE event_type = 'signup') w,
               count(value) fn, avg(value) / 10 f, count(*) qn, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0 END) q FROM events)"""))
def operational_alerts(spark, sf_dir):
    stats = events(spark, sf_dir).agg(
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 99)).alias("breaches"), F.count_if(F.col("value") < 0).alias("overdue"), F.count_if(F.col("event_type") == "signup").alias("waiting"),
        F.count("value").alias("faithfulness_n"), (F.avg("value") / 10).alias("faithfulness"), F.count("*").alias("feedback_n"), F.avg((F.col("value") > 10).cast("double")).alias("satisfaction"),
    )
    return ops.scanned_alerts(stats)


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F')
    SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = s.l_orderkey AND n.l_linenumber = s.l_linenumber)""")
def stale_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    key = ("l_orderkey", "l_linenumber")
    return ops.stale(lines.filter("l_returnflag = 'R'").select(*key), lines.filter("l_linestatus = 'F'").select(*key), key)


@query("""
    WITH stored AS (SELECT c_custkey k, 'old' v FROM customer), new AS (SELECT DISTINCT o_custkey k, 'new' v FROM orders WHERE o_totalprice > 200000)
    SELECT * FROM new UNION ALL SELECT * FROM stored WHERE k NOT IN (SELECT k FROM new)""")
def chunk_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k"), F.lit("new").alias("v")).distinct()
    return ops.upserted(stored, new, ("k",))


@query("""
    WITH l AS (SELECT source kb_id, doc_id path, sha256(text) h, CASE WHEN n_chars < 50 THEN 'too short' END error FROM documents),
         s AS (SELECT source kb_id, doc_id path, CASE WHEN lang = 'de' THEN 'changed' ELSE sha256(text) END h FROM documents WHERE lang <> 'fr')
    SELECT l.kb_id, l.path, CASE WHEN error IS NOT NULL THEN 'FAIL' WHEN s.h IS NULL THEN 'NEW' WHEN s.h = l.h THEN 'SKIP' ELSE 'UPDATE' END "plan"
    FROM l LEFT JOIN s ON s.kb_id = l.kb_id AND s.path = l.path""")
def ingest_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id"), F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "lang", "n_chars")
    state = d.filter("lang <> 'fr'").withColumn("sha256", F.when(F.col("lang") == "de", "changed").otherwise(F.col("sha256")))
    return ops.ingest_plan(d.withColumn("error", F.when(F.col("n_chars") < 50, "too short")), state)


@query("""
    WITH m AS (SELECT doc_id path, n_chars size, sha256(text) h FROM documents WHERE lang <> 'es'),
         f AS (SELECT doc_id path, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END size, CASE WHEN lang = 'de' THEN 'x' ELSE sha256(text) END h FROM documents WHERE source <> 'src1')
    SELECT coalesce(m.path, f.path) path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN m.size <> f.size THEN 'size' WHEN m.h <> f.h THEN 'hash' ELSE 'ok' END finding
    FROM m FULL JOIN f ON m.path = f.path""")
def manifest_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "lang", "source")
    files = d.filter("source <> 'src1'").withColumn("size", F.when(F.col("lang") == "fr", F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(F.col("lang") == "de", "x").otherwise(F.col("sha256")))
    return ops.reconciled(d.filter("lang <> 'es'"), files)


@query(f"""SELECT o_orderstatus status, count(*) n, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND o_orderstatus = 'F') deleted,
                  count(*) FILTER (WHERE NOT (o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND o_orderstatus = 'F')) stays FROM orders GROUP BY o_orderstatus""")
def retention_cleanup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stays = ops.kept(o, "o_orderdate", 365, AS_OF, F.col("o_orderstatus") == "F").groupBy("o_orderstatus").agg(F.count("*").alias("stays"))
    total = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    both = total.join(stays, "o_orderstatus", "left").withColumn("stays", F.coalesce("stays", F.lit(0)))
    return both.select(F.col("o_orderstatus").alias("status"), "n", (F.col("n") - F.col("stays")).alias("deleted"), "stays")


@query(f"""SELECT l_returnflag, count(*) n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY)) GROUP BY l_returnflag""")
def retention_cascade(spark, sf_dir):
    parents = ops.kept(table(spark, sf_dir, "orders"), "o_orderdate", 365, AS_OF).select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.cascaded(table(spark, sf_dir, "lineitem"), parents, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


_MOVES = ", ".join(f"('{a}', '{b}')" for a, b in ops.CONVERSATION_STATES)
_STATE = "CASE event_type WHEN 'view' THEN 'ai' WHEN 'click' THEN 'waiting' WHEN 'purchase' THEN 'human' ELSE 'closed' END"


@query(f"""
    WITH s AS (SELECT user_id, {_STATE} b, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) a FROM events)
    SELECT a from_state, b to_state, count(*) n, (a, b) IN ({_MOVES}) legal FROM s WHERE a IS NOT NULL GROUP BY a, b""")
def fsm_transitions(spark, sf_dir):
    state = F.when(F.col("event_type") == "view", "ai").when(F.col("event_type") == "click", "waiting").when(F.col("event_type") == "purchase", "human").otherwise("closed")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = events(spark, sf_dir).select(F.lag(state).over(w).alias("from_state"), state.alias("to_state")).filter("from_state IS NOT NULL")
    return ops.transitions(moves.groupBy("from_state", "to_state").agg(F.count("*").alias("n")), ops.CONVERSATION_STATES)


@query("""
    SELECT conv_id, turn, CASE WHEN role = 'agent' THEN 'assistant' ELSE role END AS role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def recent_history(spark, sf_dir):
    return ops.history(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), 3)


@query("""
    SELECT conv_id, turn, string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) context FROM conversations""")
def neighbor_window(spark, sf_dir):
    from ..operators import chunking

    return chunking.around(table(spark, sf_dir, "conversations"), 2, "conv_id", "turn").select("conv_id", "turn", "context")


@query("""SELECT conv_id, turn, lag(turn) OVER w previous_turn, lead(turn) OVER w next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prev_next_links(spark, sf_dir):
    from ..operators import chunking

    rows = chunking.linked(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.col("previous").alias("previous_turn"), F.col("next").alias("next_turn"))


@query("""
    WITH s AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') l, min(turn) FILTER (WHERE role = 'assistant') f FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, count(*) FILTER (WHERE role = 'user' AND turn > coalesce(l, -1)) unread, any_value(f) first_response FROM conversations c JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id""")
def unread_counts(spark, sf_dir):
    return ops.unread(table(spark, sf_dir, "conversations"))


@query(f"""SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'signup') AND value > 50 AND ts + INTERVAL 10 MINUTE < TIMESTAMP '{EVENTS_AS_OF}'""")
def sla_breach(spark, sf_dir):
    waiting, answered = F.col("event_type").isin("click", "signup"), F.col("value") <= 50
    return events(spark, sf_dir).filter(ops.breached(waiting, answered, F.col("ts").cast("timestamp"), EVENTS_AS_OF)).select("event_id", "user_id")


@query(f"""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '{AS_OF}'""")
def overdue_tickets(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("processing")
    return table(spark, sf_dir, "orders").filter(ops.overdue(status, F.col("o_orderdate"), AS_OF)).select("o_orderkey")


@query("""
    WITH g AS (SELECT DISTINCT n_nationkey k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3))
    SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT k FROM g)""")
def rbac_semi_join(spark, sf_dir):
    grants = table(spark, sf_dir, "nation").filter("n_regionkey IN (1, 3)").select(F.lit("u1").alias("user_id"), F.col("n_nationkey").alias("kb_id"))
    return ops.readable(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "kb_id"), grants, "u1").select("s_suppkey", "s_name")


@query("""
    WITH e AS (SELECT event_id, event_type, value, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END k FROM events)
    SELECT event_id FROM e WHERE (k IS NULL OR k <> 3) AND (k IS NULL OR k NOT IN (4, 5)) AND (event_type = 'view' OR coalesce(value >= 50, false)) AND NOT (coalesce(k > 7, false))""")
def where_filters(spark, sf_dir):
    k = F.when(F.col("user_id") % 3 != 0, F.get_json_object("props", "$.k").cast("long"))
    condition = {"$and": [{"k": {"$ne": 3, "$nin": [4, 5]}}, {"$or": [{"event_type": "view"}, {"value": {"$gte": 50}}]}], "$not": {"k": {"$gt": 7}}}
    return filters.where(events(spark, sf_dir).withColumn("k", k), condition).select("event_id")


@query("""SELECT event_type, count(*) n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT sum_k, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) kinds FROM events GROUP BY event_type""")
def json_extract_stats(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.count_distinct(k).alias("kinds"))


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, list(event_id ORDER BY ts, event_id) ids, list(epoch_us(ts) ORDER BY ts, event_id) t FROM events GROUP BY user_id),
    s AS (SELECT user_id, ids, t, 0 i, CAST([] AS BIGINT[]) seen, CAST([] AS BOOLEAN[]) ok FROM e
          UNION ALL SELECT user_id, ids, t, i + 1, CASE WHEN len(k) < 3 THEN list_append(k, t[i + 1]) ELSE k END, list_append(ok, len(k) < 3)
          FROM (SELECT *, list_filter(seen, lambda x: x > t[i + 1] - {6 * 3600 * 1_000_000}) k FROM s WHERE i < len(t)))
    SELECT unnest(ids) event_id, user_id, unnest(ok) admitted FROM s WHERE i = len(t)""")
def sliding_rate_limit(spark, sf_dir):
    return ops.admitted(events(spark, sf_dir).select("event_id", "user_id", "ts"), 3, 6 * 3600).select("event_id", "user_id", "admitted")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) n FROM events""")
def sliding_window_counts(spark, sf_dir):
    return ops.admitted_at_most(events(spark, sf_dir), 6 * 3600).select("event_id", "user_id", "n")


@query("""
    SELECT user_id case_id, count(*) FILTER (WHERE value > 20) n_passed, count(*) n_runs,
           CASE WHEN count(*) FILTER (WHERE value > 20) = count(*) THEN 'stable_pass' WHEN count(*) FILTER (WHERE value > 20) = 0 THEN 'stable_fail' ELSE 'flaky' END stability
    FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def repeat_stability(spark, sf_dir):
    return evaluate.stability(events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("user_id").alias("case_id"), (F.col("value") > 20).alias("passed")))


def _report(spark, sf_dir, half: str):
    e = events(spark, sf_dir).filter(half)
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg((F.col("value") > 50).cast("double")), 4).alias("value"), F.count("*").alias("denominator"))


_HALVES = ("ts < TIMESTAMP '2024-01-15 00:00:00'", "ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'signup'")
_REPORTS = """
    b AS (SELECT event_type metric, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) AS value, count(*) denominator FROM events WHERE {} GROUP BY event_type),
    n AS (SELECT event_type metric, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) AS value, count(*) denominator FROM events WHERE {} GROUP BY event_type),
    j AS (SELECT coalesce(b.metric, n.metric) metric, b.value base_value, n.value new_value, round(n.value - b.value, 4) delta,
                 CASE WHEN b.metric IS NULL OR n.metric IS NULL THEN 'missing' WHEN b.value IS NULL OR n.value IS NULL THEN 'not_scoreable' ELSE 'ok' END status,
                 b.denominator IS DISTINCT FROM n.denominator denominators_differ, coalesce(least(b.denominator, n.denominator) < 10, false) small_sample FROM b FULL JOIN n ON b.metric = n.metric),
    diff AS (SELECT *, CASE WHEN status <> 'ok' THEN status WHEN (CASE WHEN metric = 'error' THEN -delta ELSE delta END) > 0 THEN 'better' WHEN (CASE WHEN metric = 'error' THEN -delta ELSE delta END) < 0 THEN 'worse' ELSE 'same' END verdict FROM j)""".format(*_HALVES)


@query(f"WITH {_REPORTS} SELECT * FROM diff")
def report_diff(spark, sf_dir):
    return evaluate.report_diff(_report(spark, sf_dir, _HALVES[0]), _report(spark, sf_dir, _HALVES[1]), ("error",))


@query(f"""WITH {_REPORTS}, r AS (SELECT * FROM (VALUES ('view', 'require_gain', CAST(0.01 AS DOUBLE)), ('click', 'limit_regression', 0.05), ('signup', 'limit_regression', 0.5)) t(metric, kind, bound))
    SELECT r.metric, kind, bound, delta, coalesce(status = 'ok' AND CASE WHEN kind = 'require_gain' THEN delta >= bound ELSE delta >= -bound END, false) passed FROM r LEFT JOIN diff ON diff.metric = r.metric""")
def quality_gate(spark, sf_dir):
    rules = ops.rows(spark, [("view", "require_gain", 0.01), ("click", "limit_regression", 0.05), ("signup", "limit_regression", 0.5)], "metric", "kind", "bound")
    return evaluate.gates(report_diff(spark, sf_dir), rules)


@query("""
    SELECT l_returnflag, count(*) total, count(*) FILTER (WHERE l_quantity > 10) n_passed, round(avg(CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.0 END), 4) pass_rate,
           round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 4) answerable_accuracy, round(avg(l_quantity), 3) latency_avg, round(max(l_quantity), 3) latency_max,
           quantile_disc(l_quantity, 0.5) p50, quantile_disc(l_quantity, 0.95) p95 FROM lineitem GROUP BY l_returnflag""")
def eval_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") > 10).alias("passed"), (F.col("l_discount") > 0.05).alias("answerable_ok"), F.col("l_quantity").alias("latency"))
    return evaluate.summary(rows, ["l_returnflag"])


@query("""
    WITH a AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'P')
    SELECT coalesce(a.k, b.k) case_id, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def case_set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderstatus")
    return evaluate.unlike_ids(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"))


@query("""SELECT o_custkey doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) version_no FROM orders""")
def version_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    return ops.versioned(rows, order="o_orderkey").withColumn("version_no", F.col("version_no").cast("long"))


@query("""SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def presence_join(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", F.col("c_mktsegment").alias("grp"))
    presence = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    return ops.present(users, presence, "BUILDING").select(F.col("user_id").alias("c_custkey"), "c_name", "o_orderkey")


@query("""SELECT user_id thread, max(event_id) step, arg_max(event_type, event_id) state FROM events GROUP BY user_id""")
def thread_states(spark, sf_dir):
    return ops.latest_states(events(spark, sf_dir).select(F.col("user_id").alias("thread"), F.col("event_id").alias("step"), F.col("event_type").alias("state")))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) n FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """The windows that the stream counts, over the whole table."""
    from ..streaming import jobs

    return jobs.windowed(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
