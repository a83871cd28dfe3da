import random
import re
from collections import Counter

import numpy as np

from evidex.llm import divergence as d


def plain(rows):
    """By the definition: rows of (text, lang, source)."""
    groups, documents = {}, {}
    for text, lang, source in rows:
        lang = lang or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault((lang, source or ""), Counter()).update(terms)
        documents.setdefault(lang, Counter()).update(set(terms))
    out = set()
    for lang, seen in documents.items():
        kept = [t for t, n in seen.items() if n >= 3]
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            pairs = {r: sum((p[s][t] - p[r][t]) ** 2 // p[r][t] for t in kept) for r in own if r != s}
            terms = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if own[s][t] and p[s][t] > q[t]}
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    letters = ["a", "b", "é", "Z", "ß", "世", "\U0001f600", "th"]
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(700)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(700)], k=rng.randint(0, 60))
        rows.append((rng.choice([" ", ", ", "\x7f", "1"]).join(words), rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "é", None, "S1"])))
    return rows + [(None, "en", "s1"), ("", "fr", "s9"), (None, "fr", None), ("x", "lone", "one"), ("rare words once", "lone", "two"), (rows[0][0], rows[0][1], rows[0][2])]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, rank int")


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_the_definition(spark, monkeypatch):
    rows = corpus()
    want = plain(rows)
    assert any(r[:3] == ("fr", "s9", "pair") and r[4] == 0 for r in want)
    assert found(d.audited(frame(spark, rows))) == want
    for name, value in (("COUNTERS", 50), ("BURST", 2), ("PIECE", 16), ("CELLS", 1), ("SENT", 0)):
        monkeypatch.setattr(d, name, value)
    # nothing is in place of another at other sizes of tries, pieces and blocks
    assert found(d.audited(frame(spark, rows).repartition(5))) == want
    assert d.audited(frame(spark, rows).limit(0)).count() == 0


def test_only_the_first_200_terms_in_order(spark):
    rows = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en", "s")] * 3 + [("other words here", "en", "t")] * 3
    got = found(d.audited(frame(spark, rows)))
    assert got == plain(rows)
    assert sorted(r[5] for r in got if r[1:3] == ("s", "term")) == list(range(1, 201))


def test_long_texts_in_pieces(monkeypatch):
    text = ("Abc déf " * 40 + "x" * 300 + " 7 end").encode()
    whole = text.translate(d.FOLD).split()
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(d, "PIECE", size)
        assert [t for some in d.pieces(text) for t in some] == whole
    assert list(d.pieces(b"")) == []


def test_tries_merge_and_walk_in_byte_order(monkeypatch):
    monkeypatch.setattr(d, "BURST", 3)
    rng = random.Random(3)
    words = ["".join(rng.choices("abé", k=rng.randint(0, 5))).encode() for _ in range(400)]
    one, two, want = d.Trie(), d.Trie(), {}
    for i, w in enumerate(words):
        (one if i % 2 else two).add_document(f"s{i % 3}", {w: i})
        documents, counts = want.setdefault(w, [0, {}])
        want[w][0] = documents + 1
        counts[f"s{i % 3}"] = counts.get(f"s{i % 3}", 0) + i
    merged = list(one.merge(two).walk())
    assert [t for t, _ in merged] == sorted(want) and dict(merged) == want
    assert one.counters == sum(len(c) for _, c in want.values())


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(2000):
        total = rng.randint(1, 1 << rng.randint(1, 52))
        count = rng.randint(0, total)
        assert int(d.shares(np.array([count]), np.int64(total))[0]) == 1 + 1_000_000_000 * count // total
