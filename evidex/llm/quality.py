"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned at quantiles of the sample. Cyclic boosting visits one feature after the
other and adds a shallow tree's steps, at a small rate, to that feature's table over its bins; then the
pairs of features that explain most of what is left get tables over coarse bins in the same way. A score
is a sum of table entries, found for a batch of rows at once.

The sample is bounded: about ``SAMPLE`` labelled rows, drawn by a hash of the id at a rate that follows
their count. Only its features, ``len(FEATURES)`` numbers a row, reach the driver. Scoring is a map over
all whole texts.

Defined results: a null text counts as empty and is scored like any other; without any label to learn
from, all scores are 0.5; rows without an id or label are never learned from; equal labels of an id count
once, different ones each, and of documents that share an id the text of the least hash is learned from;
repeated rows give repeated results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import sys
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_filter, arrow_map, per_process
from .langid import fold_of

FOLDS, HELD_OUT = 3, 1
SAMPLE = 8000
BINS, COARSE, ROUNDS, RATE, LEAST, PAIRS, PAIR_ROUNDS = 48, 8, 120, 0.15, 5, 6, 40

FEATURES = (
    "log_chars", "word_length", "upper", "digits", "symbols", "spaces", "distinct_words", "top_word", "repeats", "distinct_lines",
    "line_words", "stops", "short_words", "symbol_ends", "titles", "bars", "shouts", "entropy", "log_words", "long_words",
)


def classes() -> np.ndarray:
    """Each code point's class: 0 lower or other letter, 1 upper, 2 digit, 3 white space, 4 anything else."""
    out = np.full(sys.maxunicode + 1, 4, np.uint8)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        out[c] = 1 if x.isupper() else 0 if x.isalpha() else 2 if x.isdigit() else 3 if x.isspace() else 4
    return out


def features(text: str | None, of: np.ndarray) -> list[float]:
    text = text or ""
    n = max(1, len(text))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(of[points], minlength=5)
    letters = max(1, kinds[0] + kinds[1])
    shares = np.bincount(np.minimum(points, 1023), minlength=1024) / n
    seen = shares[shares > 0]
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w, met, sizes = max(1, len(words)), Counter(words), list(map(len, words))
    common = met.most_common(1)[0][1] if met else 0
    return [
        np.log1p(len(text)), sum(sizes) / w, kinds[1] / letters, kinds[2] / n, kinds[4] / n, kinds[3] / n, len(met) / w, common / w,
        sum(map(str.__eq__, words, words[1:])) / w, len(set(lines)) / max(1, len(lines)), np.log1p(w / max(1, len(lines))), text.count(".") / w,
        sum(k <= 3 for k in sizes) / w, sum(not x[-1].isalnum() for x in met) / max(1, len(met)), sum(map(str.istitle, met)) / max(1, len(met)), text.count("|") / w,
        text.count("!") / w, float(-(seen * np.log2(seen)).sum()), np.log1p(len(words)), sum(k > 12 for k in sizes) / w,
    ]


def _bin(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, x, side="right")


@dataclass
class Model:
    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for rows of features."""
        z = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            z += table[_bin(x[:, k], self.cuts[k])]
        for a, b, table in self.pairs:
            z += table[_bin(x[:, a], self.coarse[a]), _bin(x[:, b], self.coarse[b])]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A step for each bin: a tree of two levels of splits, from the bins' gradients, curvatures and counts."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    left, low, many = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = left**2 / (low + 1) + (g.sum() - left) ** 2 / (h.sum() - low + 1)
    gain[(many < LEAST) | (n.sum() - many < LEAST)] = -1
    at = int(gain.argmax()) + 1
    if gain[at - 1] < 0:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])


def _sums(bins, size, *weights):
    return [np.bincount(bins, w, minlength=size) for w in weights]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows of features; y: 0 or 1. The order of rows does not matter."""
    if not len(y):
        return Model()
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Model(float(np.log(mean / (1 - mean))))
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        model.cuts.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) > BINS else (values[1:] + values[:-1]) / 2)
        model.coarse.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, COARSE + 1)[1:-1])))
        model.tables.append(np.zeros(len(model.cuts[k]) + 1))
    bins = [_bin(x[:, k], c) for k, c in enumerate(model.cuts)]
    z, one = np.full(len(y), model.start), np.ones(len(y))
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(*_sums(b, len(model.tables[k]), y - p, p * (1 - p), one))
            model.tables[k] += step
            z += step[b]
    rough = [_bin(x[:, k], c) for k, c in enumerate(model.coarse)]
    p = 1 / (1 + np.exp(-z))
    ranked = []
    for a, b in itertools.combinations(range(len(bins)), 2):
        width = len(model.coarse[b]) + 1
        g, h = _sums(rough[a] * width + rough[b], (len(model.coarse[a]) + 1) * width, y - p, p * (1 - p))
        ranked.append((float((g**2 / (h + 1)).sum()), a, b))
    for _, a, b in sorted(ranked, reverse=True)[:PAIRS]:
        model.pairs.append((a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))))
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            p = 1 / (1 + np.exp(-z))
            g, h = _sums(rough[a] * table.shape[1] + rough[b], table.size, y - p, p * (1 - p))
            step = RATE * (g / (h + 1)).reshape(table.shape)
            table += step
            z += step[rough[a], rough[b]]
    return model


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    key = F.col(id_col)
    usable = labels.filter((fold_of(key, FOLDS) != HELD_OUT) & F.col(label_col).isNotNull()).select(key.alias("id"), F.col(label_col).cast("int").alias("y"))
    n = usable.count()
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 40))
    some = usable.filter(draw < int(min(1, SAMPLE / max(1, n)) * (1 << 40)))
    # about ``SAMPLE`` rows of two numbers, so this broadcast does not grow with the input
    joined = df.select(key.alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")

    def start():
        of = per_process(("classes",), classes)

        def step(ids, ys, hashes, texts):
            return ids, ys, hashes, [features(t, of) for t in texts]

        return step

    made = arrow_map(joined, ["id", "y", F.xxhash64("text").alias("h"), "text"], start, "id long, y int, h long, x array<double>")
    rows = made.groupBy("id", "y").agg(F.min(F.struct("h", "x")).alias("least")).collect()
    rows = sorted((r["id"], r["y"], r["least"]["x"]) for r in rows)
    return fit(np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r[1]) for r in rows]))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def start():
        of = per_process(("classes",), classes)

        def step(ids, held, texts):
            s = model.scores(np.array([features(t, of) for t in texts]))
            return ids, held, s.tolist(), (s >= 0.5).astype(int).tolist()

        return step

    held = F.coalesce(fold_of(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False))
    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text")], start, "doc_id long, held_out boolean, score double, predicted int")


def good(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score ``least`` or more; columns as they are."""

    def start():
        of = per_process(("classes",), classes)
        return lambda texts: model.scores(np.array([features(t, of) for t in texts])) >= least

    return arrow_filter(df, text_col, start)
