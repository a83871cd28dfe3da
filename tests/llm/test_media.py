import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import webp_writer as other

from evidex.llm import webp, webp_writer


@pytest.mark.parametrize("colours", [1, 2, 3, 11, 90])
@pytest.mark.parametrize("transforms", [(), ("green",), ("cross",), ("predictor",), ("palette",), ("predictor", "cross", "green"), ("green", "cross"), ("palette", "predictor")])
def test_reads_what_the_format_allows(colours, transforms):
    rng = np.random.default_rng(colours)
    for height, width in ((1, 1), (7, 13), (21, 34)):
        image = other.picture(rng, height, width, colours)
        for options in ({}, {"cache_bits": 4}, {"group_bits": 2}, {"cache_bits": 7, "group_bits": 3, "simple": False}, {"back": False}):
            data = other.write(image, transforms, **options)
            back, n = webp.decode(data)
            assert n == len(data) and (back == image).all(), (height, width, options)


def test_noise_needs_long_codes():
    rng = np.random.default_rng(9)
    image = np.minimum(rng.exponential(12, (60, 50, 4)), 255).astype(np.uint8)
    assert (webp.decode(other.write(image, ("green",), cache_bits=1))[0] == image).all()


def test_own_files_round_trip():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (64, 128, 4096, 4160, 64 * 1000, (1 << 20) + 64)]
    payloads += [bytes(rng.integers(97, 97 + k, 64 * k, dtype=np.uint8)) for k in range(1, 28)]
    media = webp_writer.stored(payloads)
    assert [x.tobytes() for x in webp.read(media)] == payloads
    # what stands beside an image does not change it
    assert [webp_writer.stored([p])[0] for p in payloads] == media


def of_pixels(f, n=256):
    """A text whose bytes are the four samples of pixels, by a function of the pixel's number."""
    return "".join(map(chr, (x for i in range(n) for x in f(i))))


STEPS = {
    "palette": "ab" * 400,
    "predictor": of_pixels(lambda i: (33 + i % 16 + i // 16 * 3, 40 + 2 * (i % 16) + i // 16 * 2, 50 + 3 * (i % 16) + i // 16, 40 + 4 * (i % 16) + i // 16)),
    "subtract_green": of_pixels(lambda i: (40 + i * i * 7 % 61, 35 + i * i * 7 % 61, 37 + i * i * 7 % 61, 50 + i % 3)),
    "cross_colour": of_pixels(lambda i: (30 + i * i * 7 % 61 // 2, 35 + i * i * 7 % 61, 80 - i * i * 7 % 61 // 2, 50 + i % 3)),
    "copies": "\n".join(f"| {k} | a line that comes again and again in a long table |" for k in range(40)),
    "cached": " ".join(np.random.default_rng(3).choice("oak elm ash fir yew bay box fig may sal asp nut gum tea hop".split(), 900)),
    "prefix": "words of a text that nothing else would make any shorter than its own letters do",
}


@pytest.mark.parametrize("step", STEPS)
def test_documents_pass_through_each_step(step):
    payload, met = webp.padded(STEPS[step].encode()), Counter()
    media = webp_writer.stored([payload])
    assert webp.read(media, met)[0].tobytes() == payload
    assert met[step] > 0, met


def test_bad_files_are_refused():
    whole = webp_writer.stored([bytes(range(64))])[0]
    for data in (b"", b"RIFF\0\0\0\0WEBPVP8 ", whole[:20] + b"\0" * 40, whole[:20] + b"\x2f" + b"\xff" * 60):
        with pytest.raises(ValueError):
            webp.decode(data)


def test_query(docs, no_docs):
    rows = webp.media(docs, with_media=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        want = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert webp.read([bytes(r["media"])])[0].tobytes() == want
    assert len({r["feature"] for r in rows if r["doc_id"] == 7}) == 1
    assert webp.media(no_docs).count() == 0
