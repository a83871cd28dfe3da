import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidex.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def checked(rows, limit=packing.LIMIT):
    """No sequence is too long, and its pieces lie without gaps."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_pieces_are_the_tokenizers_own(spark, docs, tokenizer):
    rng = random.Random(0)
    texts = ["".join(rng.choice("aé 世\n1²'s<|endoftext|>") for _ in range(rng.randrange(300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text").filter("doc_id = 6"))
    got = {}
    for r in packing.pieces(df.filter("doc_id <> 6 OR length(text) > 400"), RANKS).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        if i == 6:
            continue
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        rows = sorted(got[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in rows) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in rows)
    long = sorted(got[6], key=lambda r: r["piece"])
    assert len(long) > 5 and all(r["length"] == packing.LIMIT for r in long[1:]) and long[0]["length"] <= packing.LIMIT
    assert [r["start"] for r in long[1:]] == list(np.cumsum([r["length"] for r in long[:-1]]))


def test_added_tokens_are_the_files_own(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "one<|endoftext|>two <|endoftext|> three", "<|endoftext|><|endoftext|>\n", "<|endoftext|", "a <|endoftext |> b"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS).collect()
    for r in rows:
        ids = np.array([*own.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids))
    assert len(rows) == len(texts)


def test_nnls_against_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.random(8)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_uses_each_piece_once_and_is_tight():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000, 100_000):
        lengths = np.clip(rng.lognormal(6, 1.2, n).astype(int), 1, packing.LIMIT)
        counts = np.bincount(lengths, minlength=packing.LIMIT + 1)
        ranges, sequences = packing.plan(counts)
        used = np.zeros_like(counts)
        for k, lo, hi, _, _ in sorted(ranges):
            assert lo == used[k]
            used[k] = hi
        assert (used == counts).all()
        bound = max(-(-int(lengths.sum()) // packing.LIMIT), int((lengths > packing.LIMIT // 2).sum()))
        assert sequences <= bound * 1.003 + 2
        assert len(ranges) < 20_000


def test_never_above_best_fit_decreasing():
    """Against a plain best fit, longest piece first, on the shapes of lengths where patterns gain and where they do not."""

    def best_fit(lengths):
        room, used = [0] * (packing.LIMIT + 1), 0
        for k in sorted(lengths, reverse=True):
            left = next((r for r in range(k, packing.LIMIT + 1) if room[r]), None)
            if left is None:
                used, left = used + 1, packing.LIMIT
            else:
                room[left] -= 1
            room[left - k] += 1
        return used

    rng = np.random.default_rng(7)
    shapes = [rng.lognormal(6, 1.2, 15_000), rng.lognormal(5.5, 1.2, 15_000), rng.integers(1, packing.LIMIT + 1, 15_000), rng.integers(600, 801, 15_000), rng.exponential(300, 15_000)]
    for lengths in (np.clip(x.astype(int), 1, packing.LIMIT) for x in shapes):
        assert packing.plan(np.bincount(lengths, minlength=packing.LIMIT + 1))[1] <= best_fit(lengths.tolist())


def test_whole_query(spark, docs, no_docs):
    rows = packing.packed(docs, RANKS).collect()
    checked(rows)
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 9, None}
    assert sum(r["doc_id"] == 7 for r in rows) == 2
    (empty,) = [r for r in rows if r["doc_id"] == 3]
    assert (empty["length"], empty["ids_crc32"]) == (1, zlib.crc32(b"\0\0\0\0"))
    assert packing.packed(no_docs, RANKS).count() == 0


def test_a_length_that_many_rows_share(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('x ', 700) ELSE repeat('word ', CAST(id % 97 AS INT)) END AS text")
    rows = packing.packed(df, RANKS).collect()
    n = checked(rows)
    assert len(rows) == 3000 and n <= 500  # three of the long ones do not fit in one sequence


def test_rows_that_are_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    df = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same words in every row' AS text")
    rows = packing.packed(df, RANKS).collect()
    assert len(rows) == 2000 and checked(rows) == -(-2000 // (packing.LIMIT // rows[0]["length"]))


def test_very_long_texts(spark, tokenizer):
    rng = random.Random(2)
    texts = ["some words and more of them, 12 " * 40_000, "".join(rng.choice("abcdefgh") for _ in range(300_000))]
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS).collect()
    checked(rows)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert [zlib.crc32(ids[s : s + n]) for s, n, _ in own] == [c for _, _, c in own] and sum(n for _, n, _ in own) == len(ids)
        assert all(n == packing.LIMIT for _, n, _ in own[1:])
