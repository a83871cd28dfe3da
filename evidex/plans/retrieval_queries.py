"""Retrieval over documents and embeddings; benchmark passages are the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, inverted, retrieval
from .registry import query, table


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("doc"), "source", "lang", "text")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"), "label")


def question_vectors(spark, sf_dir):
    """A question's vector is that of the row with its number."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    return q.join(vectors(spark, sf_dir).select(F.col("chunk").alias("query"), "vec"), "query")


_TERMS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+'), lambda t: length(t) > 1)"


def _bm25(docs: str, k: int, name: str = "bm25") -> str:
    """CTEs up to ``name`` (query, chunk, score, rank)."""
    return f"""
    d AS ({docs}),
    toks AS (SELECT chunk, unnest({_TERMS}) term FROM d),
    tf AS (SELECT chunk, term, count(*) tf FROM toks GROUP BY ALL),
    len AS (SELECT chunk, len({_TERMS}) n FROM d),
    tot AS (SELECT count(*) nd, avg(n) av FROM len),
    idf AS (SELECT term, ln(nd - count(*) + 0.5) - ln(count(*) + 0.5) raw FROM tf, tot GROUP BY term, nd),
    mean AS (SELECT avg(raw) m FROM idf),
    qt AS (SELECT item_id query, unnest({_TERMS}) term FROM benchmark),
    q AS (SELECT query, qt.term, count(*) times, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END w FROM qt JOIN idf ON idf.term = qt.term, mean GROUP BY ALL),
    sc AS (SELECT query, tf.chunk, round(sum(times * w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / av))), 6) score
           FROM tf JOIN q ON q.term = tf.term JOIN len ON len.chunk = tf.chunk, tot GROUP BY query, tf.chunk),
    {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) - 1 AS INTEGER) "rank" FROM sc WHERE score > 0) WHERE "rank" < {k})"""


_DOCS = "SELECT doc_id chunk, text FROM documents"


@query(f'WITH {_bm25(_DOCS, 10)} SELECT query, chunk, score, "rank" FROM bm25')
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(corpus(spark, sf_dir), questions(spark, sf_dir), 10)


@query(f"""WITH {_bm25(_DOCS + " WHERE lang = 'de'", 10)} SELECT query, chunk, score, "rank" FROM bm25""")
def bm25_filtered_topk(spark, sf_dir):
    return retrieval.bm25(corpus(spark, sf_dir).filter("lang = 'de'"), questions(spark, sf_dir), 10)


_VEC = """
    qv AS (SELECT item_id query, embedding qv FROM benchmark JOIN embeddings ON vec_id = item_id),
    vs AS (SELECT query, vec_id chunk, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) score FROM embeddings, qv {where}),
    vec AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) - 1 AS INTEGER) "rank" FROM vs) WHERE "rank" < {k})"""


@query(f'WITH {_VEC.format(where="", k=10)} SELECT query, chunk, score, "rank" FROM vec')
def vector_topk_batch(spark, sf_dir):
    return retrieval.vector_top(vectors(spark, sf_dir), question_vectors(spark, sf_dir), 10)


@query(f'WITH {_VEC.format(where="WHERE label = 1", k=10)} SELECT query, chunk, score, "rank" FROM vec')
def vector_topk(spark, sf_dir):
    return retrieval.vector_top(vectors(spark, sf_dir).filter("label = 1"), question_vectors(spark, sf_dir), 10)


@query(f'WITH {_VEC.format(where="WHERE vec_id <> query", k=1)} SELECT query, chunk, score FROM vec WHERE score >= 0.2')
def faq_match(spark, sf_dir):
    return retrieval.best_match(vectors(spark, sf_dir), question_vectors(spark, sf_dir), 0.2, others=True)


@query("""
    WITH s AS (SELECT a.vec_id query, b.vec_id chunk, round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 6) score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) - 1 AS INTEGER) "rank" FROM s) WHERE "rank" < 5""")
def vector_neighbours(spark, sf_dir):
    """The nearest of all other vectors to every vector: queries are as many as vectors, and both are data."""
    v = vectors(spark, sf_dir).select("chunk", "vec")
    return retrieval.vector_top(v, v.withColumnRenamed("chunk", "query"), 5, others=True, sent=0)


@query("""SELECT count(*) queries, 10 * count(*) hits, TRUE enough FROM benchmark JOIN embeddings ON vec_id = item_id""")
def vector_topk_approximate(spark, sf_dir):
    """An inverted file asked all questions: how many hits, and whether nine in ten of the exact ones are among them."""
    asked, v = question_vectors(spark, sf_dir), vectors(spark, sf_dir).select("chunk", "vec")
    found = inverted.search(inverted.built(v), asked, 10, probes=40)
    share = inverted.recall(found, retrieval.vector_top(v, asked, 10))
    return found.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("hits"), F.lit(share >= 0.9).alias("enough"))


_FUSED = f"""{_bm25(_DOCS, 20)}, {_VEC.format(where="", k=20)},
    f AS (SELECT coalesce(v.query, b.query) query, coalesce(v.chunk, b.chunk) chunk, v."rank" vec_rank, b."rank" bm25_rank,
                 coalesce(1.0::DOUBLE / (61 + v."rank"), 0) + coalesce(0.5::DOUBLE / (61 + b."rank"), 0) raw
          FROM vec v FULL JOIN bm25 b ON v.query = b.query AND v.chunk = b.chunk),
    fused AS (SELECT query, chunk, round(raw, 4) rrf, vec_rank, bm25_rank,
                     CAST(row_number() OVER (PARTITION BY query ORDER BY raw DESC, vec_rank NULLS LAST, bm25_rank NULLS LAST) - 1 AS INTEGER) "rank" FROM f)"""


def fused(spark, sf_dir):
    lexical = retrieval.bm25(corpus(spark, sf_dir), questions(spark, sf_dir), 20)
    return retrieval.fused(retrieval.vector_top(vectors(spark, sf_dir), question_vectors(spark, sf_dir), 20), lexical)


@query(f'WITH {_FUSED} SELECT query, chunk, rrf, vec_rank, bm25_rank, "rank" FROM fused')
def hybrid_rrf(spark, sf_dir):
    return fused(spark, sf_dir)


@query(f"""WITH {_FUSED},
    h AS (SELECT query % 10 question, query seq, chunk, rrf, "rank" FROM fused),
    s AS (SELECT question, chunk, round(sum(rrf), 4) rrf, min(seq * 1000 + "rank") first FROM h GROUP BY ALL)
    SELECT question, chunk, rrf, CAST(row_number() OVER (PARTITION BY question ORDER BY rrf DESC, first, chunk) - 1 AS INTEGER) "rank" FROM s""")
def multi_query_fusion(spark, sf_dir):
    hits = fused(spark, sf_dir).select((F.col("query") % 10).alias("question"), F.col("query").alias("seq"), "chunk", "rrf", "rank")
    return retrieval.many_fused(hits)


@query(f"""WITH {_FUSED},
    h AS (SELECT query, chunk, source doc, "rank" r FROM fused JOIN documents ON doc_id = chunk),
    k AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY r) n FROM h)
    SELECT query, chunk, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY r) - 1 AS INTEGER) "rank" FROM k WHERE n <= 1""")
def per_doc_cap(spark, sf_dir):
    docs = corpus(spark, sf_dir).select("chunk", F.col("source").alias("doc"))
    return retrieval.capped(fused(spark, sf_dir).join(docs, "chunk"), 1).select("query", "chunk", "doc", "rank")


@query(f"""WITH {_FUSED},
    h AS (SELECT query, chunk, rrf, "rank" r, CASE WHEN lang = 'en' THEN 0.005 WHEN lang = 'de' THEN -0.003 ELSE 0.0 END + CASE WHEN n_chars > 2000 THEN 0.008 ELSE 0.0 END a FROM fused JOIN documents ON doc_id = chunk)
    SELECT query, chunk, rrf, CAST(a AS DOUBLE) adjustment, CAST(row_number() OVER (PARTITION BY query ORDER BY round(rrf + CAST(a AS DOUBLE), 6) DESC, r) - 1 AS INTEGER) "rank" FROM h""")
def rank_adjustment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "lang", "n_chars")
    a = F.when(F.col("lang") == "en", 0.005).when(F.col("lang") == "de", -0.003).otherwise(0.0) + F.when(F.col("n_chars") > 2000, 0.008).otherwise(0.0)
    hits = fused(spark, sf_dir).join(docs, "chunk").withColumn("adjustment", F.round(a, 6))
    return retrieval.rerank(hits, F.round(F.col("rrf") + F.col("adjustment"), 6)).select("query", "chunk", "rrf", "adjustment", "rank")


@query(f"""WITH {_FUSED}, h AS (SELECT query, max(CASE WHEN vec_rank IS NOT NULL THEN 1.0 / (1 + vec_rank) ELSE 0 END) e, bool_or(bm25_rank = 0 AND vec_rank < 5) rel FROM fused GROUP BY query)
    SELECT query, round(CAST(e AS DOUBLE), 6) evidence_score, CASE WHEN e >= 0.5 OR coalesce(rel, false) THEN 'pass' ELSE 'retry' END "action" FROM h""")
def answerability_gate(spark, sf_dir):
    hits = fused(spark, sf_dir).withColumn("score", F.lit(None).cast("double")).withColumn("rerank", F.when(F.col("vec_rank").isNotNull(), F.lit(10.0) / (1 + F.col("vec_rank"))).otherwise(0.0))
    reliable = F.coalesce((F.col("bm25_rank") == 0) & (F.col("vec_rank") < 5), F.lit(False))
    return retrieval.gated(hits.select("query", "rerank", "score", reliable.alias("reliable"), F.lit(0).alias("attempts")))


_SQUEEZE = "regexp_replace(lower({}), '\\s', '', 'g')"
_TRUTH = f"""
    truth AS (SELECT item_id case_id, doc_id doc FROM (SELECT doc_id, {_SQUEEZE.format("text")} hay FROM documents) d
              JOIN (SELECT item_id, {_SQUEEZE.format("text")} needle FROM benchmark) b ON needle <> '' AND contains(hay, needle))"""


@query(f"WITH {_TRUTH} SELECT case_id AS item, doc FROM truth")
def evidence_documents(spark, sf_dir):
    return retrieval.containing(corpus(spark, sf_dir), questions(spark, sf_dir).withColumnRenamed("query", "item"))


_SCORES = f"""{_bm25(_DOCS, 20)}, {_TRUTH},
    e AS (SELECT item_id case_id, doc FROM benchmark LEFT JOIN truth ON case_id = item_id),
    j AS (SELECT e.*, b."rank" r FROM e LEFT JOIN bm25 b ON b.query = e.case_id AND b.chunk = e.doc),
    a AS (SELECT case_id, count(doc) n_expected, {", ".join(f"count(*) FILTER (WHERE r < {k}) f{k}" for k in evaluate.KS)} FROM j GROUP BY case_id),
    cases AS (SELECT case_id, n_expected, {", ".join(f"CASE WHEN n_expected > 0 THEN CAST(f{k} > 0 AS INTEGER) END hit_at_{k}, CASE WHEN n_expected > 0 THEN round(f{k} / n_expected, 4) END recall_at_{k}" for k in evaluate.KS)},
                     CASE WHEN n_expected = 0 THEN 'not_scoreable' WHEN case_id NOT IN (SELECT query FROM bm25) THEN 'retrieval_failure' ELSE 'scored' END status FROM a)"""


def case_scores(spark, sf_dir):
    truth = evidence_documents(spark, sf_dir).select(F.col("item").alias("case_id"), "doc")
    expected = questions(spark, sf_dir).select(F.col("query").alias("case_id")).join(truth, "case_id", "left")
    hits = bm25_hits(spark, sf_dir)
    return evaluate.case_scores(expected, hits)


def bm25_hits(spark, sf_dir):
    return retrieval.bm25(corpus(spark, sf_dir), questions(spark, sf_dir), 20).select(F.col("query").alias("case_id"), F.col("chunk").alias("doc"), "rank")


@query(f"WITH {_SCORES} SELECT * FROM cases")
def hit_recall_at_k(spark, sf_dir):
    return case_scores(spark, sf_dir)


_MEASURES = [f"{m}_at_{k}" for k in evaluate.KS for m in ("hit", "recall")]


@query(f"""WITH {_SCORES} {" UNION ALL ".join(f"SELECT '{m}' metric, round(avg(CAST({m} AS DOUBLE)), 4) AS value, count({m}) denominator FROM cases" for m in _MEASURES)}""")
def retrieval_means(spark, sf_dir):
    return evaluate.means(case_scores(spark, sf_dir), _MEASURES)


@query(f"""WITH {_SCORES}, j2 AS (SELECT case_id, CASE WHEN min(r) IS NULL THEN 'absent' WHEN min(r) < 5 THEN 'top5' WHEN min(r) < 10 THEN 'top10' WHEN min(r) < 20 THEN 'top20' ELSE 'later' END bucket FROM j WHERE doc IS NOT NULL GROUP BY case_id)
    SELECT bucket, count(*) n FROM j2 GROUP BY bucket""")
def recall_rank_buckets(spark, sf_dir):
    truth = evidence_documents(spark, sf_dir).select(F.col("item").alias("case_id"), "doc")
    best = truth.join(bm25_hits(spark, sf_dir), ["case_id", "doc"], "left").groupBy("case_id").agg(evaluate.recall_bucket(F.min("rank")).alias("bucket"))
    return best.groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {_FUSED} SELECT query, count(vec_rank) n_vector, count(bm25_rank) n_lexical, count(*) FILTER (WHERE vec_rank IS NOT NULL AND bm25_rank IS NOT NULL) n_both FROM fused GROUP BY query""")
def fusion_trace(spark, sf_dir):
    both = F.count_if(F.col("vec_rank").isNotNull() & F.col("bm25_rank").isNotNull())
    return fused(spark, sf_dir).groupBy("query").agg(F.count("vec_rank").alias("n_vector"), F.count("bm25_rank").alias("n_lexical"), both.alias("n_both"))


@query(f"""
    WITH e AS (SELECT item_id item, {_SQUEEZE.format("text")} e, regexp_extract(text, '([-+]?[0-9][0-9,]*([.][0-9]+)?)', 1) num FROM benchmark),
         h AS (SELECT {_SQUEEZE.format("text")} t FROM documents),
         s AS (SELECT item, max(CASE WHEN contains(t, e) THEN 3 WHEN num <> '' AND contains(t, num) THEN 2 WHEN num <> '' AND contains(t, left(regexp_replace(num, '[-+,]', '', 'g'), 6)) THEN 1 ELSE 0 END) s FROM e, h GROUP BY item)
    SELECT item, CASE s WHEN 3 THEN 'INTACT' WHEN 2 THEN 'NUMBER_ONLY' WHEN 1 THEN 'BROKEN' ELSE 'MISSING' END "class" FROM s""")
def evidence_integrity(spark, sf_dir):
    from ..operators import gates

    return gates.integrity(questions(spark, sf_dir).select(F.col("query").alias("item"), F.col("text").alias("excerpt")), corpus(spark, sf_dir))
