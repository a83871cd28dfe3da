"""The registered queries: each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, langid, mixing, packing, quality, secret_scan, simhash, topk, url_filter, vector_codes, webp
from .common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df  # heavy work on rows: a single small file is dealt to all cores


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_secrets(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark, sf_dir):
    return bpe.coded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


SAID = "</s>[INST] ok [/INST]"


def op6_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    turns = rows.unionByName(own).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.read_back(chat.formatted(turns)).drop("attachment_tokens")


def op7_media(spark, sf_dir):
    return webp.media(table(spark, sf_dir, "documents"))


def op8_urls(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op10_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.learn(docs))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    return divergence.audited(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_secrets, op3_packing, op4_topk, op5_bpe, op6_chat, op7_media, op8_urls, op9_quality, op10_langid, op11_vector_codes, op12_mixing, op13_divergence)
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    for mark, control in reversed(chat.MARKS.items()):
        column = f"replace({column}, {_quoted(control)}, {_quoted(mark)})"
    return column


_FRAME = len(chat.OPEN) + len(chat.SAYS) + len(chat.CLOSE)
_LINK = _quoted(chat.LINK.format("|".join(chat.FILES.values())))
#: The characters of a turn's body: its text with links taken out, escaped, and a placeholder for each link.
_BODY = f"""CASE WHEN NOT contains(text, chr(1)) THEN length({_escaped(f"regexp_replace(text, {_LINK}, chr(1), 'g')")}) - len(regexp_extract_all(text, {_LINK}))
    + {" + ".join(f"len(regexp_extract_all(text, {_quoted(chat.LINK.format(endings))})) * {len(chat.HOLD.format(kind, 0))}" for kind, endings in chat.FILES.items())} ELSE length({_escaped("text")}) END"""
_RULES = " UNION ALL ".join(f"SELECT {_quoted(v)} v, {_quoted(h)} h, {_quoted(p)} p" for v, h, p in url_filter.RULES)
_BLOCKED = " OR ".join(f"host = {_quoted(b)} OR ends_with(host, {_quoted('.' + b)})" for b in url_filter.BLOCKED)



def _lloyd(rounds: int = 6) -> str:
    """Lloyd's rounds written out: components x of (row, part, place), entries c of (part, k, place), the nearest as distance * 16 + k."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, part, min(d * 16 + k) m FROM (SELECT r, part, k, sum((x - c) * (x - c)) d FROM xs JOIN b{t} USING (part, place) GROUP BY r, part, k) GROUP BY r, part)")
        if t < rounds:
            steps.append(f"""b{t + 1} AS MATERIALIZED (SELECT part, k, place, coalesce(n.c, o.c) c FROM b{t} o LEFT JOIN (SELECT part, m % 16 k, place,
                (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) c FROM xs JOIN a{t} USING (r, part) GROUP BY part, m % 16, place) n USING (part, k, place))""")
    return ",\n".join(steps)


ORACLES = {
    "op11_vector_codes": f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             xs AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // 8) part, (i - 1) % (len(v) // 8) place, v[i] x FROM v, unnest(range(1, len(v) + 1)) t(i)),
             b0 AS MATERIALIZED (SELECT part, r - 1 k, place, x c FROM xs WHERE r <= 16),
             {_lloyd()},
             e AS (SELECT r, string_agg(printf('%02x', CAST(m % 16 AS INTEGER)), '' ORDER BY part) code, CAST(sum(m // 16) AS BIGINT) error FROM a6 GROUP BY r),
             h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, k, place)) codebooks_sha256 FROM b6)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, codebooks_sha256 FROM v JOIN e USING (r), h""",
    "op13_divergence": """
        WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text FROM documents),
             t AS MATERIALIZED (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term FROM d),
             k AS MATERIALIZED (SELECT lang, term, count(*) own FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
             c AS MATERIALIZED (SELECT lang, source, term, count(*) n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
             g AS (SELECT DISTINCT lang, source FROM d),
             v AS (SELECT lang, count(*) v, sum(own) n FROM k GROUP BY lang),
             s AS (SELECT lang, source, coalesce(sum(n), 0) n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
             p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v.v) p, 1 + (1000000000::HUGEINT * (k.own + 1)) // (v.n + v.v) q
                   FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
             pairs AS (SELECT a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             f AS (SELECT a.lang, a.source, 'pair' part, b.source item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                   LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) "rank" FROM f) WHERE part = 'pair' OR "rank" <= 200""",
    "op4_topk": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {topk.SCALE}) AS BIGINT)) v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) score
                   FROM v q JOIN v c ON q.vec_id % {topk.EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) "rank" FROM s)
        SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= {topk.K}""",
    "op6_chat": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', {_quoted(SAID)} UNION ALL SELECT -1, 1, 'assistant', {_quoted(SAID)})
        SELECT conv_id, count(*) n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
               CAST(sum({_FRAME} + length({_escaped("role")}) + {_BODY}) AS BIGINT) formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_urls": f"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
             p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                          regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path FROM a),
             r AS ({_RULES}),
             m AS (SELECT DISTINCT host, path, max_by(h || p, length(h || p)) OVER w rule, max_by(v, length(h || p)) OVER w v
                   FROM (SELECT DISTINCT host, path FROM p) k JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                   WINDOW w AS (PARTITION BY host, path))
        SELECT page_id, p.host, p.path, m.rule, coalesce(m.v, CASE WHEN {_BLOCKED.replace("host", "p.host")} THEN 'block' ELSE 'allow' END) verdict,
               ({_BLOCKED.replace("host", "p.host")}) listed
        FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path""",
}
