"""Stores, logs, governance and service: what rows become, over orders, events, conversations and documents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.text import sha256
from ..operators import answers, chunking, evaluate, gates, lexical, ops, retrieval
from ..sources import readers, sinks
from ..sources.store import ChunkStore
from ..streaming import jobs
from ..tables import passing, shared_path
from .registry import query, table
from .retrieval_queries import _bm25, questions

AS_OF = "1998-01-01 00:00:00"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


# alerts
@query("""SELECT event_id id, CASE WHEN value > 95 THEN 'acknowledged' WHEN user_id % 2 = 0 THEN 'open' ELSE 'resolved' END status, CASE WHEN value > 95 THEN 'agent' || user_id END acknowledged_by FROM events WHERE event_type = 'error'""")
def alerts_acknowledged(spark, sf_dir):
    stored, asked = _alerts(spark, sf_dir)
    return ops.acknowledged(stored, asked)


def _alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    stored = e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "open").otherwise("resolved").alias("status"), F.lit(None).cast("string").alias("acknowledged_by"))
    return stored, e.filter("value > 95").select(F.col("event_id").alias("id"), F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("actor"))


@query("""SELECT event_id id, 'open' status FROM events WHERE event_type = 'error' AND value <= 95 AND user_id % 2 = 0 ORDER BY event_id DESC LIMIT 40""")
def newest_alerts(spark, sf_dir):
    return ops.alert_page(ops.acknowledged(*_alerts(spark, sf_dir)), "open", 40).select("id", "status")


# stores
@query("""SELECT conv_id doc, turn chunk_index, role chunk, text FROM conversations""")
def restored_snapshots(spark, sf_dir):
    rows = turns(spark, sf_dir).select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk_index"), F.col("role").alias("chunk"), "text")
    return ops.restored(ops.snapshot(rows))


@query("""SELECT doc_id, source FROM documents WHERE source <> (SELECT min(source) FROM documents)""")
def documents_deleted(spark, sf_dir):
    """A knowledge base's documents go by its id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ops.stale(d, d.filter(F.col("source") == F.lit(d.agg(F.min("source")).first()[0])), ("doc_id",))


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'default' ELSE lang END kb_id FROM documents WHERE lang IN ('en', 'de')""")
def default_knowledge_base(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("kb_id")).filter("kb_id IS NULL OR kb_id = 'de'")
    return sinks.with_default_kb(d)


@query("""SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 100""")
def knowledge_base_scope(spark, sf_dir):
    """A filter within the default knowledge base, which a missing id means."""
    d = table(spark, sf_dir, "documents").withColumn("kb_id", F.when(F.col("lang") != "en", F.col("lang")))
    return filters.where(d, filters.checked({"page": {"$gte": 100}}) and {"n_chars": {"$gte": 100}}, "default").select("doc_id")


@query("""SELECT DISTINCT lang kb_id FROM documents""")
def knowledge_bases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("kb_id")).distinct().orderBy("kb_id")


@query("""SELECT CAST(doc_id AS VARCHAR) path, octet_length(encode(text)) size, sha256(text) sha256 FROM documents""")
def backup_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return sinks.backup_manifest(d)


@query("""
    WITH s AS (SELECT lang kb_id, doc_id chunk, doc_id % 900 physical_id, CASE WHEN doc_id % 50 = 7 THEN 'changed' ELSE text END text FROM documents WHERE doc_id % 40 <> 3),
         e AS (SELECT lang kb_id, doc_id chunk, text FROM documents WHERE doc_id % 60 <> 5)
    SELECT CAST(physical_id AS VARCHAR) id, 'repeated' finding FROM s GROUP BY physical_id HAVING count(*) > 1
    UNION ALL SELECT coalesce(s.kb_id, e.kb_id) || '/' || coalesce(s.chunk, e.chunk), CASE WHEN s.chunk IS NULL THEN 'missing' WHEN e.chunk IS NULL THEN 'extra' ELSE 'changed' END
    FROM s FULL JOIN e ON s.kb_id = e.kb_id AND s.chunk = e.chunk WHERE s.chunk IS NULL OR e.chunk IS NULL OR s.text <> e.text""")
def migration_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("chunk"), "text")
    changed = F.when(F.col("chunk") % 50 == 7, "changed").otherwise(F.col("text"))
    stored = d.filter("chunk % 40 <> 3").select("kb_id", "chunk", (F.col("chunk") % 900).alias("physical_id"), changed.alias("text"))
    return sinks.verification(stored, d.filter("chunk % 60 <> 5"))


@query("""SELECT '# TYPE evidex_' || event_type || '_total counter' || chr(10) || 'evidex_' || event_type || '_total ' || count(*) AS value FROM events GROUP BY event_type""")
def metrics_text(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.concat("event_type", F.lit("-total")).alias("name")).agg(F.count("*").alias("value")).withColumn("kind", F.lit("counter"))
    return sinks.prometheus(counts)


@query("""SELECT event_id, 'token=***, k=' || json_extract_string(props, '$.k') AS note FROM events""")
def traces_without_secrets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("token=abc"), F.col("event_id").cast("string"), F.lit(", k="), F.get_json_object("props", "$.k")).alias("note"))
    shape = "event_id long, note string"
    return sinks.trace_lines(e).select(F.inline(F.array(F.from_json("value", shape))))


@query("""
    WITH f AS (SELECT s_suppkey, 'd' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' ELSE '.md' END path, CAST(s_suppkey * 37 % 101 AS BIGINT) length FROM supplier),
         r AS (SELECT path, length, CASE WHEN path ILIKE '%.pdf' AND row_number() OVER (PARTITION BY path ILIKE '%.pdf' ORDER BY length, path) = 1 THEN 0
                          WHEN path ILIKE '%.pdf' AND row_number() OVER (PARTITION BY path ILIKE '%.pdf' ORDER BY length DESC, path) = 1 THEN 1
                          WHEN path LIKE '%.docx' AND row_number() OVER (PARTITION BY path LIKE '%.docx' ORDER BY path) = 1 THEN 2 ELSE 3 END o FROM f)
    SELECT path, length FROM r ORDER BY o, path LIMIT 3""")
def sample_of_files(spark, sf_dir):
    k = F.col("s_suppkey")
    end = F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".docx").otherwise(".md")
    return sinks.sample_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), k.cast("string"), end).alias("path"), (k * 37 % 101).alias("length")))


@query("""SELECT conv_id, len(text) > 500 AS cut, CAST(round(turn / 7.0, 4) AS DOUBLE) evidence_score, left(text, 500) answer, '[{"chunk":' || turn || ',"score":' || CAST(round(turn / 3.0, 4) AS DOUBLE) || ',"text":"x"}]' hits
          FROM conversations WHERE role = 'assistant'""")
def log_entries(spark, sf_dir):
    t = turns(spark, sf_dir).filter("role = 'assistant'")
    hit = F.struct(F.col("turn").alias("chunk"), (F.col("turn") / 3).alias("score"), F.lit("x").alias("text"))
    rows = t.select("conv_id", (F.length("text") > 500).alias("cut"), (F.col("turn") / 7).alias("evidence_score"), F.col("text").alias("answer"), F.array(hit).alias("hits"))
    return sinks.log_rows(rows)


@query("""
    WITH l AS (SELECT event_id id, 'q' || user_id question, CAST(NULL AS DOUBLE) f, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn, user_id FROM events)
    SELECT id, question, CASE WHEN rn = 1 AND user_id % 2 = 0 THEN CAST(user_id / 10 AS DOUBLE) END faithfulness FROM l""")
def late_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    question = F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question")
    log = e.select(F.col("event_id").alias("id"), question, F.lit(None).cast("double").alias("faithfulness"))
    return sinks.backfilled(log, e.filter("user_id % 2 = 0").select(question, (F.col("user_id") / 10).alias("faithfulness")).distinct())


# governance
@query("""
    WITH v AS (SELECT o_custkey doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) version_no FROM orders WHERE o_custkey <= 100),
         c AS (SELECT min(o_custkey) c FROM orders)
    SELECT * FROM v UNION ALL SELECT doc_id, o_orderkey, (SELECT max(version_no) + 1 FROM v, c WHERE doc_id = c) FROM v, c WHERE doc_id = c AND version_no = 1""")
def version_rolled_back(spark, sf_dir):
    rows = orders(spark, sf_dir).filter("o_custkey <= 100").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    versions = ops.versioned(rows, order="o_orderkey").withColumn("version_no", F.col("version_no").cast("long"))
    first = orders(spark, sf_dir).agg(F.min("o_custkey")).first()[0]
    return ops.rolled_back(versions, first, 1)


@query("""SELECT k, a from_state, b to_state, ok legal FROM (SELECT s_suppkey k FROM supplier), (VALUES ('draft', 'review', TRUE), ('review', 'published', FALSE), ('rejected', 'review', TRUE), ('approved', 'published', TRUE), ('published', 'draft', FALSE)) t(a, b, ok)""")
def document_transitions(spark, sf_dir):
    return _moves(spark, sf_dir, (("draft", "review"), ("review", "published"), ("rejected", "review"), ("approved", "published"), ("published", "draft")), ops.DOCUMENT_STATES)


@query("""SELECT k, a from_state, b to_state, ok legal FROM (SELECT s_suppkey k FROM supplier), (VALUES ('pending', 'processing', TRUE), ('pending', 'closed', FALSE), ('processing', 'resolved', TRUE), ('resolved', 'closed', TRUE), ('closed', 'pending', FALSE)) t(a, b, ok)""")
def ticket_transitions(spark, sf_dir):
    return _moves(spark, sf_dir, (("pending", "processing"), ("pending", "closed"), ("processing", "resolved"), ("resolved", "closed"), ("closed", "pending")), ops.TICKET_STATES)


def _moves(spark, sf_dir, moves, allowed):
    each = F.array(*[F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for a, b in moves])
    return ops.transitions(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.inline(each)), allowed)


@query(f"""SELECT o_orderkey id, CAST(TIMESTAMP '{AS_OF}' + INTERVAL 15 MINUTE AS TIMESTAMP) lease_until FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '{AS_OF}'
           AND (o_orderkey % 3 = 0 OR o_orderdate + INTERVAL 1 DAY < TIMESTAMP '{AS_OF}') ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def sources_leased(spark, sf_dir):
    o = orders(spark, sf_dir)
    at = F.col("o_orderdate").cast("timestamp")
    lease = F.when(F.col("o_orderkey") % 3 != 0, at + F.expr("INTERVAL 1 DAY"))
    rows = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("enabled"), at.alias("next_sync_at"), lease.alias("lease_until"))
    return ops.leased(rows, AS_OF, 15, 25).select("id", F.col("lease_until").cast("timestamp_ntz").alias("lease_until"))


@query("""SELECT doc_id id, sha256(text) sha256, CASE WHEN lang = 'fr' THEN 'new' WHEN lang = 'de' THEN 'changed' ELSE 'unchanged' END state FROM documents""")
def source_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    last = F.when(F.col("lang") == "de", "x").when(F.col("lang") != "fr", sha256(F.col("text")))
    return ops.changed_sources(d.select(F.col("doc_id").alias("id"), last.alias("last_hash")), d.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content")))


@query(f"""SELECT 't' || c_custkey AS token, c_custkey user_id, c_mktsegment AS role FROM customer WHERE c_custkey % 3 <> 0 AND (c_acctbal >= 0 OR c_custkey % 2 = 0)""")
def tokens_known(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("t"), F.col("c_custkey").cast("string"))
    expires = F.when(F.col("c_custkey") % 2 != 0, F.when(F.col("c_acctbal") >= 0, F.to_timestamp(F.lit("2030-01-01"))).otherwise(F.to_timestamp(F.lit("1990-01-01"))))
    users = c.filter("c_custkey % 3 <> 0").select(sha256(name).alias("token_hash"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"), expires.alias("expires_at"))
    return ops.authenticated(c.select(name.alias("token")), users, AS_OF)


@query(f"""
    WITH m AS (SELECT c_custkey AS owner, 'k' AS key, 'old' AS value, c_custkey % 4 = 0 gone FROM customer),
         n AS (SELECT c_custkey AS owner, 'k' AS key, 'new' AS value, FALSE gone FROM customer WHERE c_custkey % 5 = 0)
    SELECT owner, key, value FROM (SELECT * FROM n UNION ALL SELECT * FROM m WHERE owner NOT IN (SELECT owner FROM n)) WHERE NOT gone AND owner % 3 <> 0""")
def memory_by_consent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.lit("k").alias("key"))
    gone = F.when(F.col("owner") % 4 == 0, F.to_timestamp(F.lit("1990-01-01")))
    old = c.select("owner", "key", F.lit("old").alias("value"), gone.alias("expires_at"))
    new = c.filter("owner % 5 = 0").select("owner", "key", F.lit("new").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    consent = c.select("owner", (F.col("owner") % 3 != 0).alias("enabled"))
    return ops.remembered(old, new, consent, AS_OF).select("owner", "key", "value")


# service
@query("""
    WITH r AS (SELECT conv_id, turn, 'kb' || conv_id % 3 kb_id, 'a' || conv_id % 2 agent, lower(text) t, turn % 2 = 0 waiting FROM conversations)
    SELECT conv_id, turn FROM r WHERE (waiting OR agent = 'a1') AND kb_id IN ('kb0', 'kb1') AND contains(t, 'en')""")
def agent_queue(spark, sf_dir):
    r = turns(spark, sf_dir).select(
        "conv_id", "turn", F.concat(F.lit("kb"), (F.col("conv_id") % 3).cast("string")).alias("kb_id"), F.concat(F.lit("a"), (F.col("conv_id") % 2).cast("string")).alias("agent"),
        F.lit("").alias("title"), F.lit(None).cast("string").alias("customer"), F.col("text").alias("last_text"), F.col("turn").alias("unread"), F.col("conv_id").alias("updated_at"),
    )
    return ops.agent_queue(r.filter("turn % 2 = 0"), r.filter("turn % 2 = 1"), "a1", ["kb0", "kb1"], text="EN").select("conv_id", "turn")


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') n_open, (SELECT count(*) FROM orders) total, (SELECT count(*) FILTER (WHERE quality = 1) FROM labels) positive,
                 (SELECT count(*) FROM events WHERE event_type = 'error') alerts""")
def operations_dashboard(spark, sf_dir):
    tickets = ops.status_counts(orders(spark, sf_dir).withColumnRenamed("o_orderstatus", "status"), ("O", "F"))
    feedback = ops.feedback_stats(table(spark, sf_dir, "labels"), F.col("quality"))
    alerts = table(spark, sf_dir, "events").filter("event_type = 'error'").agg(F.count("*").alias("n"))
    d = ops.dashboard(tickets=tickets, feedback=feedback, alerts=alerts)
    return d.select(F.col("tickets.n_O").alias("n_open"), "tickets.total", "feedback.positive", F.col("alerts.n").alias("alerts"))


@query("""SELECT o_custkey agent, count(*) load FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey""")
def active_load(spark, sf_dir):
    return orders(spark, sf_dir).filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("agent")).agg(F.count("*").alias("load"))


@query("""
    WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'faq' WHEN 1 THEN 'ticket' END intent, value > 80 escalate, event_type = 'view' faq_hit, 'answer ' || event_type answer,
                      CASE WHEN event_id % 2 = 0 THEN 'faq' END ei, CASE WHEN event_id % 5 < 4 THEN TRUE END ea, CASE WHEN event_id % 7 = 0 THEN event_id % 2 = 0 END ef, CASE WHEN event_id % 3 = 0 THEN 'click' END ek FROM events),
         m AS (SELECT 'intent' measure, count(*) FILTER (WHERE intent = ei) hits, count(ei) total FROM r UNION ALL SELECT 'answerable', count(*) FILTER (WHERE ea IS NOT NULL AND (NOT escalate) = ea), count(ea) FROM r
               UNION ALL SELECT 'faq', count(*) FILTER (WHERE faq_hit = ef), count(ef) FROM r UNION ALL SELECT 'keyword', count(*) FILTER (WHERE contains(answer, ek)), count(ek) FROM r)
    SELECT *, round(hits / total, 4) rate FROM m""")
def service_quality(spark, sf_dir):
    i = F.col("event_id")
    return evaluate.service_summary(table(spark, sf_dir, "events").select(
        F.when(i % 3 == 0, "faq").when(i % 3 == 1, "ticket").alias("intent"), (F.col("value") > 80).alias("escalate"), (F.col("event_type") == "view").alias("faq_hit"), F.concat(F.lit("answer "), "event_type").alias("answer"),
        F.when(i % 2 == 0, "faq").alias("expect_intent"), F.when(i % 5 < 4, True).alias("expect_answerable"), F.when(i % 7 == 0, i % 2 == 0).alias("expect_faq"), F.when(i % 3 == 0, "click").alias("expect_keyword"),
    ))


@query("""
    WITH t AS (SELECT thread, attempt, seq, token, event FROM (SELECT user_id thread, CAST(event_id % 3 AS BIGINT) attempt, event_id seq, event_type token, CASE WHEN event_type = 'purchase' THEN 'commit' ELSE 'token' END event FROM events)),
         l AS (SELECT * FROM t QUALIFY attempt = max(attempt) OVER (PARTITION BY thread))
    SELECT thread, coalesce(string_agg(token, '' ORDER BY seq) FILTER (WHERE event = 'token'), '') answer FROM l GROUP BY thread HAVING bool_or(event = 'commit')""")
def committed_answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "commit").otherwise("token")
    return jobs.committed_tokens(e.select(F.col("user_id").alias("thread"), (F.col("event_id") % 3).alias("attempt"), F.col("event_id").alias("seq"), F.col("event_type").alias("token"), kind.alias("event")))


@query("""SELECT event_id seq, user_id registry, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) > 20 AS truncated FROM events""")
def traces_evicted(spark, sf_dir):
    return jobs.evicted(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("registry")), 20)


@query("""
    WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) p FROM events),
         s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) n FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    s = jobs.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# evaluation
@query("""
    WITH h AS (SELECT item_id case_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 r FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40),
         f AS (SELECT case_id, 'doc' measure, min(r) FILTER (WHERE doc_id % 3 = case_id % 3) r FROM h GROUP BY case_id UNION ALL SELECT case_id, 'page', min(r) FILTER (WHERE doc_id % 7 = 0) FROM h GROUP BY case_id)
    SELECT measure, k, count(*) FILTER (WHERE r < k) hits, count(*) total FROM f, (SELECT CAST(unnest([5, 10, 20]) AS INTEGER) k) GROUP BY measure, k""")
def offline_totals(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"))
    from pyspark.sql import Window

    hits = b.join(d, F.col("doc_id") % 40 == F.col("case_id") % 40).withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("doc_id")) - 1)
    right = {"doc": F.col("doc_id") % 3 == F.col("case_id") % 3, "page": F.col("doc_id") % 7 == 0}
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.when(ok, F.col("r")).alias("rank")) for m, ok in right.items()])
    return evaluate.offline_totals(hits.select("case_id", F.inline(each)), (5, 10, 20))


@query("""
    WITH c AS (SELECT item_id case_id, left(text, 40) excerpt FROM benchmark UNION ALL SELECT item_id, 'nowhere ' || item_id FROM benchmark),
         h AS (SELECT item_id case_id, regexp_replace(lower(text), '\\s', '', 'g') hay FROM benchmark WHERE item_id % 3 <> 0),
         f AS (SELECT c.case_id, excerpt, coalesce(max(contains(hay, regexp_replace(lower(excerpt), '\\s', '', 'g'))), FALSE) held FROM c LEFT JOIN h ON h.case_id = c.case_id GROUP BY ALL)
    SELECT case_id, round(avg(CAST(held AS INTEGER)), 4) evidence_rate FROM f GROUP BY case_id""")
def evidence_rates(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    wanted = b.select("case_id", F.left("text", F.lit(40)).alias("excerpt")).unionByName(b.select("case_id", F.concat(F.lit("nowhere "), F.col("case_id").cast("string")).alias("excerpt")))
    return evaluate.evidence_found(wanted, b.filter("case_id % 3 <> 0"))


@query("""
    WITH w AS (SELECT s_suppkey case_id, 'Report ' || s_suppkey || '.pdf' source FROM supplier),
         h AS (SELECT s_suppkey case_id, s_suppkey % 4 AS rank, s_suppkey % 3 kind FROM supplier)
    SELECT w.case_id, source, CASE WHEN kind < 2 THEN CAST(h.rank AS BIGINT) END AS rank FROM w JOIN h ON h.case_id = w.case_id""")
def sources_found(spark, sf_dir):
    """Expected files are met by a hit's path or by its name without a known ending, in any case."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_suppkey").cast("string").alias("s"))
    want = s.select("case_id", F.concat(F.lit("Report "), "s", F.lit(".pdf")).alias("source"))
    title = F.when(F.col("case_id") % 3 == 0, F.concat(F.lit("/data/REPORT "), "s", F.lit(".PDF"))).when(F.col("case_id") % 3 == 1, F.concat(F.lit("report "), "s")).otherwise("other.pdf")
    return gates.sources_met(want, s.select("case_id", (F.col("case_id") % 4).alias("rank"), F.lit("d").alias("doc"), title.alias("title")))


@query("""
    WITH c AS (SELECT s_suppkey id, s_suppkey % 5 k FROM supplier)
    SELECT id, k NOT IN (1, 2, 3, 4) passed, CASE k WHEN 1 THEN 'answerable' WHEN 2 THEN 'keywords_all' WHEN 3 THEN 'max_citations' WHEN 4 THEN 'latency' ELSE '' END failed FROM c""")
def answer_checks(spark, sf_dir):
    k = F.col("id") % 5
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).select(
        "id", F.lit("营业 收入为5元[1]").alias("answer"), F.when(k == 3, F.array(*map(F.lit, (1, 2)))).otherwise(F.array(F.lit(1))).alias("citation_indices"), F.array(F.lit("kb")).alias("citation_kbs"), F.lit("kb").alias("kb_id"),
        F.lit(False).alias("escalate"), F.lit("kb_question").alias("intent"), F.lit(8.0).alias("score"), F.lit(0.9).alias("top_score"), F.when(k == 4, 99.0).otherwise(1.0).alias("elapsed"),
        (k != 1).alias("expect_answerable"), F.lit("kb_question").alias("expect_intent"), F.array(F.when(k == 2, "缺失").otherwise("营业收入")).alias("expect_all"), F.lit(None).cast("array<string>").alias("expect_any"),
        F.array(F.lit("无法回答")).alias("forbidden"), F.lit(1).alias("min_citations"), F.lit(1).alias("max_citations"), F.lit(True).alias("expect_inline"), F.lit(6.0).alias("min_score"), F.lit(None).cast("double").alias("min_top_score"), F.lit(30.0).alias("max_elapsed"),
    )
    failed = F.array_join(F.array_sort(F.map_keys(F.map_filter("checks", lambda _, v: ~v))), "|")
    return gates.answer_checks(c).select("id", "passed", failed.alias("failed"))


@query("""
    WITH e AS (SELECT CAST(s_suppkey AS VARCHAR) case_id, s_suppkey % 2 = 0 baseline FROM supplier WHERE s_suppkey % 10 <> 1),
         r AS (SELECT CAST(s_suppkey AS VARCHAR) case_id, s_suppkey % 3 <> 0 passed FROM supplier WHERE s_suppkey % 10 <> 2)
    SELECT 'missing' finding, case_id FROM e WHERE case_id NOT IN (SELECT case_id FROM r) UNION ALL SELECT 'unexpected', case_id FROM r WHERE case_id NOT IN (SELECT case_id FROM e)
    UNION ALL SELECT 'regressed', e.case_id FROM e LEFT JOIN r ON r.case_id = e.case_id WHERE baseline AND NOT coalesce(passed, FALSE) UNION ALL SELECT 'too few passed', NULL""")
def baseline_gate(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("case_id"))
    return gates.baseline_findings(s.filter("k % 10 <> 2").select("case_id", (F.col("k") % 3 != 0).alias("passed")), s.filter("k % 10 <> 1").select("case_id", (F.col("k") % 2 == 0).alias("baseline_passed")), 1_000_000)


@query("""SELECT * FROM (VALUES ('2', 'failed'), ('3', 'foreign citation'), ('4', 'no citations'), ('nobody', 'missing')) t(case_id, finding)""")
def required_cases(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("case_id"))
    kbs = F.when(F.col("k") == 3, F.array(F.lit("kb"), F.lit("other"))).when(F.col("k") != 4, F.array(F.lit("kb")))
    return gates.required(s.select("case_id", (F.col("k") != 2).alias("passed"), kbs.alias("citation_kbs")), ["1", "2", "3", "4", "nobody"], "kb")


@query("""SELECT * FROM (SELECT 'all' policy, count(*) FILTER (WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) n_passed, count(*) total FROM supplier UNION ALL SELECT 'without pages', count(*) FILTER (WHERE s_suppkey % 2 = 0), count(*) FROM supplier)""")
def relaxed_policies(spark, sf_dir):
    checks = F.create_map(F.lit("doc"), F.col("s_suppkey") % 2 == 0, F.lit("page"), F.col("s_suppkey") % 3 == 0)
    return gates.relaxed(table(spark, sf_dir, "supplier").select(checks.alias("checks")), {"all": [], "without pages": ["page"]})


@query("""SELECT doc_id id, length(regexp_replace(lower(text), '\\s', '', 'g')) >= 200 AND contains(regexp_replace(lower(text), '\\s', '', 'g'), 'the') passed FROM documents""")
def recognised_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(200).alias("min_chars"), F.array(F.lit("T he")).alias("terms"))
    return gates.recognised(d).select("id", "passed")


@query("""
    WITH q AS (SELECT s_suppkey query, s_suppkey % 3 period FROM supplier),
         c AS (SELECT s_suppkey doc, s_suppkey % 3 period, s_suppkey % 2 = 0 is_table FROM supplier UNION ALL SELECT s_suppkey, 0, TRUE FROM supplier),
         p AS (SELECT query, doc FROM q JOIN c ON c.period = q.period WHERE is_table)
    SELECT q.query, count(p.doc) period_pool, count(*) FILTER (WHERE p.doc = q.query) locked_pool,
           CASE WHEN count(*) FILTER (WHERE p.doc = q.query) > 0 THEN 'routed' WHEN count(p.doc) > 0 THEN 'not in pool' ELSE 'pool empty' END outcome
    FROM q LEFT JOIN p ON p.query = q.query GROUP BY q.query""")
def route_feasibility(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), (F.col("s_suppkey") % 3).alias("period"))
    c = s.select(F.col("query").alias("doc"), "period", (F.col("query") % 2 == 0).alias("is_table")).unionByName(s.select(F.col("query").alias("doc"), F.lit(0).cast("long").alias("period"), F.lit(True).alias("is_table")))
    return gates.route_pools(s, c, s.select("query", F.col("query").alias("doc")))


# retrieval pieces
@query("""SELECT conv_id query, turn, string_agg(m, '；' ORDER BY o) line FROM (
            SELECT conv_id, turn, 1 o, 'page=' || turn m FROM conversations UNION ALL SELECT conv_id, turn, 2, 'section_path=' || role FROM conversations WHERE role <> 'user' UNION ALL SELECT conv_id, turn, 3, 'is_table=false' FROM conversations) GROUP BY ALL""")
def metadata_lines(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.col("conv_id").alias("query"), "turn", F.col("turn").alias("page"), F.when(F.col("role") != "user", F.col("role")).otherwise("").alias("section_path"), F.lit(False).alias("is_table"))
    return t.select("query", "turn", answers.metadata_line(t).alias("line"))


@query("""SELECT conv_id query, string_agg('[' || turn + 1 || '] page=' || turn || chr(10) || '内容：' || left(text, 50), chr(10) || chr(10) ORDER BY turn) context FROM conversations GROUP BY conv_id""")
def context_texts(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.col("conv_id").alias("query"), F.col("turn").alias("rank"), F.col("turn").alias("page"), "text")
    return answers.context_blocks(t, 50)


@query("""SELECT conv_id, turn, left(text, 120) text FROM conversations""")
def citations(spark, sf_dir):
    """What a citation shows of a passage, without what is internal."""
    return turns(spark, sf_dir).withColumn("snapshot", F.col("text")).withColumn("path", F.lit("/internal")).drop("snapshot", "path", "role").select("conv_id", "turn", F.substring("text", 1, 120).alias("text"))


@query("""
    WITH h AS (SELECT conv_id query, turn AS rank, text, conv_id % 4 k FROM conversations),
         s AS (SELECT query, rank, text, CASE WHEN rank % 3 = 0 THEN NULL ELSE CAST((rank * 7 + query) % 5 AS DOUBLE) END sc FROM h)
    SELECT query, text, CAST(row_number() OVER (PARTITION BY query ORDER BY sc DESC NULLS LAST, rank) - 1 AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY sc DESC NULLS LAST, rank) <= 3""")
def reranked_hits(spark, sf_dir):
    h = turns(spark, sf_dir).select(F.col("conv_id").alias("query"), F.col("turn").alias("rank"), "text")
    score = F.when(F.col("rank") % 3 != 0, ((F.col("rank") * 7 + F.col("query")) % 5).cast("double"))
    return retrieval.rerank(h, score, 3).select("query", "text", "rank")


@query("""
    WITH h AS (SELECT conv_id query, turn AS chunk, CAST(turn AS BIGINT) r FROM conversations),
         s AS (SELECT query, min(chunk) chunk FROM h WHERE chunk >= 2 AND query % 2 = 0 GROUP BY query),
         k AS (SELECT query, chunk, r FROM h WHERE r < 2 UNION ALL SELECT query, chunk, -1 FROM s)
    SELECT query, chunk, CAST(row_number() OVER (PARTITION BY query ORDER BY r) - 1 AS INTEGER) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY query ORDER BY r) <= 2""")
def protected_hits(spark, sf_dir):
    """The first certain candidate stands in front where the best hits lack it."""
    h = turns(spark, sf_dir).select(F.col("conv_id").alias("query"), F.col("turn").alias("chunk"), F.col("turn").alias("rank"))
    sure = h.withColumn("certain", (F.col("chunk") >= 2) & (F.col("query") % 2 == 0))
    return answers.protected(h, sure, 2)


@query("""SELECT conv_id query, CAST(i - 1 AS INTEGER) seq, v[i] AS text FROM (SELECT conv_id, list_filter(list_transform(list(DISTINCT trim(left(text, 20)) ORDER BY trim(left(text, 20))), lambda x: x), lambda x: x <> '') v FROM conversations GROUP BY conv_id), (SELECT unnest([1, 2, 3]) i) WHERE i <= len(v)""")
def expanded_queries(spark, sf_dir):
    v = turns(spark, sf_dir).groupBy(F.col("conv_id").alias("query")).agg(F.array_sort(F.collect_list(F.trim(F.left("text", F.lit(20))))).alias("variants"))
    return retrieval.expanded(v, 3)


@query("""
    WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events)
    SELECT user_id, event_id FROM a WHERE r <= 10 AND r > 4""")
def dropped_by_stage(spark, sf_dir):
    """Ids that one stage's ranking has and the next one's lacks."""
    from pyspark.sql import Window

    a = table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return ops.stale(a.filter("r <= 10"), a.filter("r <= 4"), ("user_id", "event_id")).select("user_id", "event_id")


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100""")
def recent_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("""SELECT CAST(min(doc_id) AS BIGINT) doc_id, sha256(text) h FROM documents GROUP BY sha256(text)""")
def hits_by_text(spark, sf_dir):
    """Hits that no id tells apart are one by their text's hash, the first of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("one", F.lit(1))
    return ops.first_of_each_hash(d, "text", ("one",), "doc_id").select("doc_id", F.col("content_hash").alias("h"))


@query("""SELECT o_custkey kind, count(DISTINCT o_orderpriority) n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey""")
def clues_shared(spark, sf_dir):
    o = orders(spark, sf_dir)
    both = o.select("o_custkey").intersect(o.filter("o_orderstatus = 'P'").select("o_custkey"))
    return o.join(both, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("kind")).agg(F.count_distinct("o_orderpriority").alias("n"))


@query("""SELECT k, CASE WHEN k % 4 = 0 THEN 'model ' || k ELSE 'template ' || k END brief, CASE WHEN k % 4 = 0 THEN 'llm' ELSE 'template' END brief_source FROM (SELECT s_suppkey k FROM supplier)""")
def briefs_with_fallback(spark, sf_dir):
    from ..operators import metrics

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("s"))
    model = F.when(F.col("k") % 4 == 0, F.concat(F.lit("model "), "s")).when(F.col("k") % 4 == 1, "  ")
    brief, source = metrics.written(model, F.concat(F.lit("template "), "s"))
    return s.select("k", brief.alias("brief"), source.alias("brief_source"))


# files and stores
@query("""SELECT doc_id AS chunk, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS version FROM documents WHERE lang = 'de' AND n_chars >= 200""")
def stored_chunks(spark, sf_dir):
    """A store of chunks written for two knowledge bases, rewritten in part, and scanned for one of them with a condition."""
    path = shared_path(spark, "store")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "n_chars", "lang", F.lit("old").alias("version"))
    for lang in ("de", "en"):
        sinks.write_chunks(d.filter(F.col("lang") == lang).drop("lang"), path, lang)
    sinks.write_chunks(d.filter("lang = 'de' AND chunk % 7 = 0").drop("lang").withColumn("version", F.lit("new")), path, "de")
    return readers.chunks(spark, passing(spark, path), "de", {"n_chars": {"$gte": 200}}).select("chunk", "version")


def versioned_store(spark, sf_dir):
    """Documents in a store by six commits: two knowledge bases, an upsert, a deleted source, one that is replaced by shorter rows, and one that is restored."""
    store = ChunkStore(spark, shared_path(spark, "versions"))
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("kb_id"), F.col("source").alias("doc"), F.col("doc_id").alias("chunk"), "text", F.lit("first").alias("state"))
    store.append(d.filter("kb_id = 'de'"))
    store.append(d.filter("kb_id IN ('en', 'fr')"))
    store.upsert(d.filter("kb_id IN ('de', 'en') AND chunk % 7 = 0").withColumn("state", F.lit("upsert")))
    store.delete(d.filter("doc = 'src1'").select("kb_id", "doc"))
    store.replace_documents(d.filter("kb_id = 'de' AND doc = 'src2' AND chunk % 2 = 0").withColumn("state", F.lit("replaced")))
    store.restore(d.filter("kb_id = 'de' AND doc = 'src1'").select("kb_id", "doc"), 3)
    passing(spark, store.path)
    return store


_VERSIONS = """
    own AS (SELECT lang kb_id, source doc, doc_id chunk, text FROM documents WHERE lang IN ('de', 'en', 'fr')),
    s AS (SELECT v, kb_id, doc, chunk, text,
                 CASE WHEN v >= 5 AND kb_id = 'de' AND doc = 'src2' THEN 'replaced' WHEN v >= 3 AND kb_id IN ('de', 'en') AND chunk % 7 = 0 THEN 'upsert' ELSE 'first' END state
          FROM own, (SELECT unnest([1, 2, 3, 4, 5, 6]) v)
          WHERE (v >= 2 OR kb_id = 'de') AND NOT (v >= 4 AND doc = 'src1' AND NOT (v = 6 AND kb_id = 'de')) AND NOT (v >= 5 AND kb_id = 'de' AND doc = 'src2' AND chunk % 2 = 1))"""


@query(f"WITH {_VERSIONS} SELECT CAST(v AS INTEGER) store_version, kb_id, doc, chunk, state FROM s")
def store_versions(spark, sf_dir):
    """Every version of a store, read after all its commits."""
    store = versioned_store(spark, sf_dir)
    return functools.reduce(DataFrame.unionByName, [store.read(v).select(F.lit(v).alias("store_version"), "kb_id", "doc", "chunk", "state") for v in store.versions()])


@query(f"WITH {_VERSIONS} SELECT kb_id, doc, count(*) n, sum(length(text)) chars, max(state) last_state FROM s WHERE v = 6 GROUP BY kb_id, doc")
def store_compacted(spark, sf_dir):
    """The last version after compaction, in which nothing is hidden any more and old folders are gone."""
    store = versioned_store(spark, sf_dir)
    store.compact()
    store.vacuum(1)
    return store.read().groupBy("kb_id", "doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("state").alias("last_state"))


@query(f"""WITH {_VERSIONS}, {_bm25("SELECT chunk, text FROM s WHERE v = 6", 10)} SELECT query, chunk, score, "rank" FROM bm25""")
def bm25_over_commits(spark, sf_dir):
    """An index made of a store's second version that then followed four commits, asked all questions in the last one."""
    store = versioned_store(spark, sf_dir)
    index = lexical.SegmentIndex(spark, shared_path(spark, "index"))
    for version in (2, 6):
        index.update(store, until=version)
    passing(spark, index.path)
    return index.search(questions(spark, sf_dir), 10).select("query", "chunk", "score", "rank")


@query("""SELECT n_name AS line, 'txt' extension FROM nation""")
def text_files(spark, sf_dir):
    """Files of a folder, scanned, and read as documents."""
    path = shared_path(spark, "files")
    table(spark, sf_dir, "nation").select("n_name").repartition(3, "n_name").write.text(path)
    found = readers.scan(spark, passing(spark, path)).select("path", "extension")
    return readers.documents(spark, path).join(found, "path").select(F.explode(F.split(F.trim(F.regexp_replace("text", "\\n$", "")), "\\n")).alias("line"), "extension").filter("line <> ''")


@query("""SELECT 'pass_rate' metric, CAST(round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 4) AS DOUBLE) AS value FROM events UNION ALL SELECT 'total', CAST(count(*) AS DOUBLE) FROM events""")
def report_files(spark, sf_dir):
    """A report's summary, in the shape that keeps it below its first part."""
    path = shared_path(spark, "report")
    figures = table(spark, sf_dir, "events").agg(F.round(F.avg((F.col("value") > 50).cast("double")), 4).alias("pass_rate"), F.count("*").alias("total"))
    part = F.struct(F.struct("pass_rate", "total", F.lit("x").alias("label")).alias("summary"))
    figures.select(F.to_json(F.struct(F.array(part).alias("reports"))).alias("value")).coalesce(1).write.text(path)
    return readers.report_summary(spark, passing(spark, path))


@query("""SELECT conv_id, CASE WHEN count(DISTINCT role) FILTER (WHERE turn < 2 AND role <> 'system') = 1 THEN any_value(role) FILTER (WHERE turn < 2 AND role <> 'system') ELSE '' END one FROM conversations GROUP BY conv_id""")
def only_values(spark, sf_dir):
    """A window's field where all that have it agree."""
    t = turns(spark, sf_dir).withColumn("r", F.when((F.col("turn") < 2) & (F.col("role") != "system"), F.col("role")).otherwise(""))
    return t.groupBy("conv_id").agg(chunking.only_value("r").alias("one"))
