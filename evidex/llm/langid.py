"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded (letters to lower case, everything else to one space), their n-grams of one to three
characters are hashed to ``BUCKETS``, and counts become log(1 + count) * idf, of length 1. The weights are
learned by follow-the-regularised-leader with L1 and L2 penalties, document by document; a temperature is
then fitted on a fifth of the sample that the weights never saw.

Document frequencies are those of all documents that may be learned from, added up in each task and then
by bucket. Only the weights come from a sample: about ``PER_LANGUAGE`` documents of each language, and about
``SAMPLE`` in all, but one of each language at least, drawn by a hash of the id at a rate that follows each
language's count, so nothing is shuffled or sorted for it.
Its feature vectors are made on executors and only these reach the driver; the model is
``BUCKETS`` x languages numbers. Scoring is a map over all whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any document to
learn from, all are; documents without an id or language are never learned from; of rows that share an id
and a language, the text of the least hash may be in the sample; repeated rows give repeated results; of equal scores the first language in order wins; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_filter, arrow_map, per_process

BUCKETS, ORDERS = 8192, 3
PER_LANGUAGE, SAMPLE = 600, 6000
FOLDS, HELD_OUT = 4, 2
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.01
UNDETERMINED = "und"
#: Characters of a text that are hashed at a time.
STRIDE = 1 << 18


def folding() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(low) if len(low := x.lower()) == 1 else c
    return table


def counts(text: str, fold: np.ndarray) -> np.ndarray | None:
    """Counts of n-grams by bucket; None if the text has no letter."""
    points = fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (points != 32).any():
        return None
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), STRIDE):
        part = points[at : at + STRIDE + ORDERS - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(ORDERS):
            h = (h[: len(h) - (n > 0)] + part[n:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            # an n-gram belongs to the stride that it begins in
            out += np.bincount(((h[:STRIDE] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 13), minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (buckets and 1)
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of a text with n n-grams in each bucket ``at``: buckets and values, and the constant."""
        x = np.log1p(n) * self.idf[at]
        return np.append(at, BUCKETS), np.append(x / max(np.linalg.norm(x), 1e-12), 1.0)

    def chances(self, c: np.ndarray) -> np.ndarray:
        at = np.nonzero(c)[0]
        at, x = self.vector(at, c[at])
        return _softmax(self.weights[:, at] @ x / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[int, str, np.ndarray, np.ndarray]], seen: np.ndarray) -> Model:
    """rows: (a hash that orders and splits them, language, buckets, counts). seen: documents by bucket, and of all."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    names = sorted({r[1] for r in rows})
    model = Model(names, np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1, np.zeros((len(names), BUCKETS + 1)))
    if not rows:
        return model
    data = [(names.index(r[1]), *model.vector(r[2], r[3])) for r in rows]
    learn = [d for i, d in enumerate(data) if i % 5] or data
    z, n, w = (np.zeros_like(model.weights) for _ in range(3))
    for _ in range(EPOCHS):
        for y, at, x in learn:
            zs, ns = z[:, at], n[:, at]
            ws = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            p = _softmax(ws @ x)
            p[y] -= 1
            g = p[:, None] * x
            z[:, at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * ws
            n[:, at] = ns + g * g
            w[:, at] = ws
    model.weights = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rest = [d for i, d in enumerate(data) if i % 5 == 0]
    raw, ys = np.array([model.weights[:, at] @ x for _, at, x in rest]), np.array([y for y, _, _ in rest])

    def loss(t):
        return -np.log(np.maximum(_softmax(raw / t)[np.arange(len(ys)), ys], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.25, 5, 60), key=loss))
    return model


def fold_of(id_col, folds: int) -> F.Column:
    return F.crc32(id_col.cast("string")) % folds


def frequencies(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many documents of ``df`` have n-grams in each bucket, and, last, how many have a letter."""

    def run(batches):
        fold, seen = per_process(("folding",), folding), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for t in batch.slice(k, SLICE).column(0).to_pylist():
                    if (c := counts(t, fold)) is not None:
                        seen[:BUCKETS] += c > 0
                        seen[BUCKETS] += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["at", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in df.select(text_col).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    key = F.col(id_col)
    usable = df.filter((fold_of(key, FOLDS) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40))
    # every language that occurs has a share: one that no draw would reach, its least
    sizes = usable.filter(F.col(text_col).rlike(r"\p{L}")).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"), F.min(draw).alias("least")).orderBy("lang").collect()
    if not sizes:
        return fit([], np.zeros(BUCKETS + 1, np.int64))
    each = min(PER_LANGUAGE, SAMPLE // len(sizes))
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(r["least"] + 1, int(min(1, each / r["n"]) * (1 << 40))))])
    some = usable.filter(draw < F.element_at(rate, F.col(lang_col)))

    def start():
        fold = per_process(("folding",), folding)

        def step(keys, langs, hashes, texts):
            rows = [(k, lang, h, c) for k, lang, h, t in zip(keys, langs, hashes, texts) if (c := counts(t, fold)) is not None]
            at = [np.nonzero(r[3])[0] for r in rows]
            return *([r[k] for r in rows] for k in range(3)), [x.tolist() for x in at], [r[3][x].tolist() for r, x in zip(rows, at)]

        return step

    columns = [draw.alias("k"), F.col(lang_col).alias("l"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")]
    made = arrow_map(some, columns, start, "k long, lang string, h long, at array<int>, n array<long>")
    rows = made.groupBy("k", "lang").agg(F.min(F.struct("h", "at", "n")).alias("x")).collect()  # the sample is bounded
    return fit([(r["k"], r["lang"], np.array(r["x"]["at"], np.int32), np.array(r["x"]["n"], np.int64)) for r in rows], frequencies(usable, text_col))


def identified(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def start():
        judge = judging(model)

        def step(ids, held, texts):
            return ids, held, *zip(*map(judge, texts))

        return step

    held = F.coalesce(fold_of(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False))
    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text")], start, "doc_id long, held_out boolean, lang_pred string, score double")


def judging(model: Model):
    """A function from a text to its language and score."""
    fold = per_process(("folding",), folding)

    def judge(text):
        c = counts(text, fold) if text and model.languages else None
        if c is None:
            return UNDETERMINED, 0.0
        p = model.chances(c)
        return model.languages[int(p.argmax())], float(p.max())

    return judge


def with_language(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is known with a score of ``least`` or more; columns as they are."""

    def start():
        judge = judging(model)

        def wanted(texts):
            found = map(judge, texts)
            return [lang != UNDETERMINED and score >= least for lang, score in found]

        return wanted

    return arrow_filter(df, text_col, start)
