import math

import corpus_pipeline as p
import plain
import public_tokenizers
import tiktoken
from test_models import corpus
from test_packing import checked
from test_secrets import base_by_definition
from test_simhash import plain as fingerprint

from evidex.llm import langid, packing, quality


def quality_score(text, model):
    """The sum of the entries that the features of a text find in the model's tables."""
    x, z = plain.features(text), model.start

    def place(v, edges):
        return sum(e <= v for e in edges)

    z += sum(t[place(v, c)] for v, t, c in zip(x, model.tables, model.cuts))
    z += sum(t[place(x[a], model.coarse[a])][place(x[b], model.coarse[b])] for a, b, t in model.pairs)
    return 1 / (1 + math.exp(-z))


def masked(text):
    """Secrets that stand in the text as they are; the texts of the test hold no other."""
    out, at = "", 0
    for s, _, e in base_by_definition(text):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def brute(rows, languages, model):
    """The stages before packing by plain loops and definitions, with the models given."""
    usable = [plain.ngrams(r[1]) for r in rows if r[1] and r[2] and __import__("zlib").crc32(str(r[0]).encode()) % langid.FOLDS != langid.HELD_OUT]
    usable = [c for c in usable if c]
    seen = {}
    for c in usable:
        for b in c:
            seen[b] = seen.get(b, 0) + 1
    weights = [{b: float(w[b]) for b in w.nonzero()[0]} for w in languages.weights]
    kept = [r for r in rows if plain.language(r[1], languages.languages, weights, languages.temperature, seen, len(usable))[1] >= p.LANGUAGE_SCORE]
    kept = [r for r in kept if quality_score(r[1], model) >= p.QUALITY_SCORE]
    prints, out = [], []
    for r in sorted(kept):
        prints.append(fingerprint(r[1]))
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    for i, r in enumerate(sorted(kept)):
        if group[i] == i:
            out.append((r[0], masked(r[1])))
    return out


def test_stages_and_run_match_brute_force(spark, tmp_path):
    docs, labels = corpus(spark, 400)
    extra = [(900, "token=abcdefghij and that they have this from which one would", "en", "s", 1), (901, "token=abcdefghij and that they have this from which one would", "en", "s", 1), (902, "12345", "en", "s", 5), (903, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "quality", "near_dedup", "secrets", "packing"]
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    languages = langid.learn(docs)
    model = quality.learn(langid.with_language(docs, languages, p.LANGUAGE_SCORE), labels)
    want = brute([tuple(r) for r in docs.collect()], languages, model)
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in now.collect())
    assert [(i, t) for i, t, _ in got] == want and all(n == len(t) for _, t, n in got)
    assert any(i == 900 and t.startswith("[SECRET]") for i, t, _ in got) and not {901, 902, 903} & {i for i, _, _ in got}
    rows = p.run(spark, str(tmp_path)).collect()
    checked(rows)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r["doc_id"], r["length"]) for r in rows) == [(i, len(coder.encode_ordinary(t)) + 1) for i, t in want]
