import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from evidex.llm import bpe

NAME = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def table():
    return bpe.ranks(NAME)


@pytest.fixture(scope="module")
def library(table):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_pattern_splits_as_its_original():
    own, original = bpe.compiled_pattern(), regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(0)
    known = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and __import__("unicodedata").category(chr(c)) not in ("Cn", "Co")]
    for _ in range(300):
        text = "".join(rng.choice(known) if rng.random() < 0.5 else rng.choice(" \n\t\x1c'sdlve1a_²") for _ in range(80))
        assert own.findall(text) == [m for m in original.findall(text)], repr(text)


def test_merges_by_definition_small():
    table = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"ca": 260, b"bcab": 261}
    t = bpe.Transducer(table)
    rng = random.Random(1)
    for _ in range(4000):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
        want = [table[piece]] if piece in table else bpe.merged(table, piece)
        assert t.encode(piece) == want


def test_equals_the_library(table, library, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeiouàéßñ thenrd'ls.,\n 12²世界\U0001f600") for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    texts += ["a" * 3000, " " * 500 + "x", "=-" * 800, "é" * 900, "the" * 700, "", "<|endoftext|>"]
    want = [library.encode_ordinary(t) for t in texts]
    coder = bpe.Encoder(table)
    assert [coder.encode(t) for t in texts] == want
    monkeypatch.setattr(bpe, "STATES", 30)
    monkeypatch.setattr(bpe, "MEMO", 10)
    assert [coder.encode(t) for t in texts] == want


def test_streaming_decoder(table, library):
    decoder = bpe.Decoder(table)
    text = "naïve 世界 \U0001f600 ça " * 200
    parts = list(decoder.stream(library.encode_ordinary(text), piece=3))
    assert b"".join(parts).decode() == text
    assert all(p.decode() for p in parts)  # each part ends between characters
    with pytest.raises(ValueError):
        list(decoder.stream([table[b"\xe4"]]))
    with pytest.raises(ValueError):
        list(decoder.stream([table[b"\xff"]]))


def test_utf8_machine_is_pythons():
    for n in (1, 2):
        for k in range(256**n):
            data = k.to_bytes(n, "big")
            state = 0
            for b in data:
                state = bpe.UTF8[state][b] if state >= 0 else -1
            try:
                data.decode()
                ok = True
            except UnicodeDecodeError:
                ok = False
            assert (state == 0) == ok


def test_query(docs, no_docs, library):
    rows = bpe.coded(docs, NAME).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            ids = library.encode_ordinary(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.coded(no_docs, NAME).count() == 0
