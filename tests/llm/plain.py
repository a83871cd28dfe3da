"""The models by their definitions, in plain Python: one number at a time, nothing from the library but its constants."""

import math
from collections import Counter

from evidex.llm import langid, quality

WORD = 0xFFFFFFFF


def folded(text):
    out = [" "]
    for c in text:
        low = c.lower()
        out.append((low if len(low) == 1 else c) if c.isalpha() else " ")
    return [*out, " "]


def ngrams(text):
    """Bucket to count, None if there is no letter."""
    points = [ord(c) for c in folded(text)]
    if all(p == 32 for p in points):
        return None
    out = Counter()
    for i in range(len(points)):
        h = 0
        for n, p in enumerate(points[i : i + langid.ORDERS]):
            h = (h + p) * 0x9E3779B1 & WORD
            h ^= h >> 15
            out[((h + n * 0x85EBCA6B) * 0xC2B2AE35 & WORD) >> (32 - int(math.log2(langid.BUCKETS)))] += 1
    return out


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def vector(counts, seen, n_docs):
    x = {b: math.log(1 + c) * (math.log((1 + n_docs) / (1 + seen.get(b, 0))) + 1) for b, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {b: v / norm for b, v in x.items()} | {langid.BUCKETS: 1.0}


def languages(rows, seen, n_docs):
    """(names, weights by language and bucket) of follow-the-regularised-leader, from (key, language, counts)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    names = sorted({r[1] for r in rows})
    learn = [(names.index(lang), vector(c, seen, n_docs)) for i, (_, lang, c) in enumerate(rows) if i % 5]
    z, n = ([Counter() for _ in names] for _ in range(2))

    def weight(k, b):
        if abs(z[k][b]) <= langid.L1:
            return 0.0
        return -(z[k][b] - math.copysign(langid.L1, z[k][b])) / ((langid.BETA + math.sqrt(n[k][b])) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for y, x in learn:
            w = [{b: weight(k, b) for b in x} for k in range(len(names))]
            p = softmax([sum(w[k][b] * v for b, v in x.items()) for k in range(len(names))])
            for k in range(len(names)):
                for b, v in x.items():
                    g = (p[k] - (k == y)) * v
                    z[k][b] += g - (math.sqrt(n[k][b] + g * g) - math.sqrt(n[k][b])) / langid.ALPHA * w[k][b]
                    n[k][b] += g * g
    return names, [{b: weight(k, b) for b in z[k]} for k in range(len(names))]


def language(text, names, weights, temperature, seen, n_docs):
    counts = ngrams(text or "")
    if counts is None:
        return "und", 0.0
    x = vector(counts, seen, n_docs)
    p = softmax([sum(w.get(b, 0.0) * v for b, v in x.items()) / temperature for w in weights])
    return names[p.index(max(p))], max(p)


def features(text):
    text = text or ""
    n, words, lines = max(1, len(text)), text.split(), [x for x in text.split("\n") if x]
    upper = sum(c.isupper() for c in text)
    letters = sum(c.isupper() or c.isalpha() for c in text)
    digits = sum(c.isdigit() and not (c.isupper() or c.isalpha()) for c in text)
    spaces = sum(c.isspace() for c in text)
    met, w = Counter(words), max(1, len(words))
    shares = Counter(min(ord(c), 1023) for c in text)
    return [
        math.log(1 + len(text)),
        sum(map(len, words)) / w,
        upper / max(1, letters),
        digits / n,
        (len(text) - letters - digits - spaces) / n,
        spaces / n,
        len(met) / w,
        max(met.values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        len(set(lines)) / max(1, len(lines)),
        math.log(1 + w / max(1, len(lines))),
        sum(c == "." for c in text) / w,
        sum(len(x) <= 3 for x in words) / w,
        sum(not x[-1].isalnum() for x in met) / max(1, len(met)),
        sum(x.istitle() for x in met) / max(1, len(met)),
        sum(c == "|" for c in text) / w,
        sum(c == "!" for c in text) / w,
        -sum(c / n * math.log2(c / n) for c in shares.values()),
        math.log(1 + len(words)),
        sum(len(x) > 12 for x in words) / w,
    ]


def tree(bins, depth):
    """A step for each bin of (gradient, curvature, count): the best split, by trying each, and so on below it."""
    g, h, n = (sum(b[k] for b in bins) for k in range(3))
    tried = []
    for at in range(1, len(bins)) if depth else ():
        (gl, hl, nl), (gr, hr, nr) = ([sum(b[k] for b in part) for k in range(3)] for part in (bins[:at], bins[at:]))
        if nl >= quality.LEAST and nr >= quality.LEAST:
            tried.append((gl * gl / (hl + 1) + gr * gr / (hr + 1), -at))
    if not tried:
        return [g / (h + 1)] * len(bins)
    at = -max(tried)[1]
    return tree(bins[:at], depth - 1) + tree(bins[at:], depth - 1)


def additive(x, y, cuts, coarse, pairs):
    """Scores of the rows it was fitted to: cyclic boosting of a table for each feature, then of one for each pair."""
    mean = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    z = [math.log(mean / (1 - mean))] * len(y)

    def sums(where):
        out = {}
        for i, at in enumerate(where):
            p = 1 / (1 + math.exp(-z[i]))
            g, h, n = out.get(at, (0.0, 0.0, 0))
            out[at] = g + y[i] - p, h + p * (1 - p), n + 1
        return out

    def place(v, edges):
        return sum(e <= v for e in edges)

    bins = [[place(r[k], c) for r in x] for k, c in enumerate(cuts)]
    for _ in range(quality.ROUNDS):
        for k, where in enumerate(bins):
            found = sums(where)
            step = tree([found.get(b, (0.0, 0.0, 0)) for b in range(len(cuts[k]) + 1)], 2)
            for i, at in enumerate(where):
                z[i] += quality.RATE * step[at]
    for _ in range(quality.PAIR_ROUNDS):
        for a, b in pairs:
            where = [(place(r[a], coarse[a]), place(r[b], coarse[b])) for r in x]
            found = sums(where)
            for i, at in enumerate(where):
                z[i] += quality.RATE * found[at][0] / (found[at][1] + 1)
    return [1 / (1 + math.exp(-v)) for v in z]
