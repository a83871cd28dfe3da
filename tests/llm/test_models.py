import random
import zlib

import numpy as np
import plain

from evidex.llm import langid, quality

WORDS = {"en": "the and of with that have this from they which one would".split(), "de": "der die und mit von nicht eine auch sich dem für über".split(), "fr": "le les des une que dans pour sur avec être où très".split()}


def corpus(spark, n=900):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(4, 60))]
        good = rng.random() < 0.7
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_languages_held_out(spark, docs, no_docs):
    own, _ = corpus(spark)
    model = langid.learn(own)
    assert 0 < model.temperature <= 5 and (model.weights == 0).any()
    lang = {r["doc_id"]: r["lang"] for r in own.collect()}
    rows = langid.identified(own, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    edge = {r["doc_id"]: r for r in langid.identified(docs, model).collect()}
    assert {edge[k]["lang_pred"] for k in (3, 4, 5)} == {"und"} and edge[None]["held_out"] is False
    assert langid.identified(no_docs, langid.learn(no_docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identified(docs, langid.learn(no_docs)).collect()} == {"und"}
    kept = langid.with_language(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_language_counts_by_definition():
    fold = langid.folding()
    text = "Ab, Ça1世"
    points = [32] + [ord(c.lower()) if c.isalpha() else 32 for c in text] + [32]
    assert int(langid.counts(text, fold).sum()) == 3 * len(points) - 3
    long = "abc ñ" * 200_000
    once, stride = langid.counts(long, fold), langid.STRIDE
    try:
        langid.STRIDE = 1000
        assert (langid.counts(long, fold) == once).all()
    finally:
        langid.STRIDE = stride
    assert langid.counts("123 !", fold) is None


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F

    own, labels = corpus(spark, 300)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    spoilt = own.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert (langid.learn(own).weights == langid.learn(spoilt).weights).all()
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(own, labels), quality.learn(own, wrong)
    assert all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_quality_held_out(spark, docs, no_docs):
    own, labels = corpus(spark)
    model = quality.learn(own, labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.scored(own, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97
    edge = quality.scored(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in edge)
    assert len({r["score"] for r in edge if r["doc_id"] in (3, 4)}) == 1
    assert quality.scored(no_docs, quality.learn(no_docs, labels)).count() == 0
    none = quality.learn(own, labels.limit(0))
    assert {r["score"] for r in quality.scored(own, none).collect()} == {0.5}


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    model = quality.fit(x, y)
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.9
    for row in x[:50]:
        z = model.start + sum(t[np.searchsorted(c, v, side="right")] for t, c, v in zip(model.tables, model.cuts, row))
        z += sum(t[np.searchsorted(model.coarse[a], row[a], side="right"), np.searchsorted(model.coarse[b], row[b], side="right")] for a, b, t in model.pairs)
        assert abs(1 / (1 + np.exp(-z)) - model.scores(row[None])[0]) < 1e-12
    order = rng.permutation(500)
    again = quality.fit(x[order], y[order])
    assert np.allclose(again.scores(x), model.scores(x))


def test_document_frequencies_and_languages_are_the_whole_inputs(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 2)
    monkeypatch.setattr(langid, "EPOCHS", 1)
    # 300 languages, of which the first has many documents
    rows = [(i, f"word{'abcdefghij'[i % 10]} and {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", f"l{max(0, i - 700)}") for i in range(1000)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % langid.FOLDS != langid.HELD_OUT]
    assert model.languages == sorted({r[2] for r in used})
    fold = langid.folding()
    seen = sum((langid.counts(r[1], fold) > 0).astype(int) for r in used)
    assert np.allclose(model.idf, np.log((1 + len(used)) / (1 + seen)) + 1)
    assert len(langid.learn(spark.createDataFrame([(i, "some words", f"l{i}") for i in range(600)], "doc_id long, text string, lang string")).languages) > 256


TEXTS = ["", None, "A", "12 34", "Ab, Ça1世 ǅ x² ½", "one two\n\ntwo TWO Two.\ntwo | a-very-long-word! ??", "ÀÉ\u2028İ b\x0bc\x0cd e\x85f " * 9, "<|x|> \U0001f600 token\ttoken token"]


def test_counts_and_features_by_definition():
    fold, of = langid.folding(), quality.classes()
    for text in TEXTS:
        want, got = plain.ngrams(text or ""), langid.counts(text or "", fold)
        assert (want is None) == (got is None) and (want is None or dict(want) == {int(k): int(got[k]) for k in np.nonzero(got)[0]})
        assert np.allclose(quality.features(text, of), plain.features(text), atol=1e-12), text


def test_languages_by_definition(spark, docs):
    own, _ = corpus(spark, 160)
    model = langid.learn(own)
    rows = [tuple(r)[:3] for r in own.collect()]
    usable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % langid.FOLDS != langid.HELD_OUT]
    counts = {i: plain.ngrams(t) for i, t, _ in usable}
    seen = {}
    for c in counts.values():
        for b in c:
            seen[b] = seen.get(b, 0) + 1
    keys = {r["doc_id"]: r["k"] for r in own.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 7), {1 << 40}L) k").collect()}
    names, weights = plain.languages([(keys[i], lang, counts[i]) for i, _, lang in usable], seen, len(usable))
    assert names == model.languages
    for k, w in enumerate(weights):
        full = np.zeros(langid.BUCKETS + 1)
        full[list(w)] = list(w.values())
        assert np.allclose(full, model.weights[k], atol=1e-9)
    everything = own.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000 doc_id", "text"))
    text = {r["doc_id"]: r["text"] for r in everything.collect()}
    for r in langid.identified(everything, model).collect():
        if r["doc_id"] is not None:
            lang, score = plain.language(text[r["doc_id"]], names, weights, model.temperature, seen, len(usable))
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9


def test_quality_by_definition(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 6)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 5)
    own, labels = corpus(spark, 240)
    model = quality.learn(own, labels)
    texts = {r["doc_id"]: r["text"] for r in own.collect()}
    ys = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = [i for i in sorted(texts) if zlib.crc32(str(i).encode()) % quality.FOLDS != quality.HELD_OUT]
    want = plain.additive([plain.features(texts[i]) for i in ids], [ys[i] for i in ids], model.cuts, model.coarse, [p[:2] for p in model.pairs])
    got = {r["doc_id"]: r["score"] for r in quality.scored(own, model).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-9)


def test_what_is_learned_does_not_depend_on_the_order_of_rows(spark):
    own, labels = corpus(spark, 120)
    more = own.selectExpr("doc_id", "concat(text, ' and more of it') text", "lang", "source", "n_chars")
    both = own.unionByName(more).unionByName(own)
    other = more.unionByName(own).repartition(7).unionByName(own)
    a, b = langid.learn(both), langid.learn(other)
    assert (a.weights == b.weights).all() and a.temperature == b.temperature
    c, d = quality.learn(both, labels.unionByName(labels)), quality.learn(other, labels)
    assert all((x == y).all() for x, y in zip(c.tables, d.tables))


def test_very_long_texts_by_definition():
    text = "Word, other. ña 12 | " * 25_000 + "x" * 60_000 + "\nend"
    want, got = plain.ngrams(text), langid.counts(text, langid.folding())
    assert dict(want) == {int(k): int(got[k]) for k in np.nonzero(got)[0]}
    assert np.allclose(quality.features(text, quality.classes()), plain.features(text))
