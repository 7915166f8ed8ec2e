"""What the image encoder chooses, and both ways of the decoder on it."""

import hashlib
import zlib

import numpy as np
import pytest

from corelode.llm import webp


def _images():
    draw = np.random.default_rng(1)
    line = draw.integers(32, 120, (1, 64, 3)).astype(np.uint8)
    yield "repeated rows", np.concatenate([np.repeat(line, 5, axis=0), draw.integers(32, 120, (4, 64, 3)).astype(np.uint8), line])
    yield "period of two pixels", np.tile(draw.integers(32, 120, (1, 2, 3)).astype(np.uint8), (9, 32, 1))
    yield "bytes of references' codes", draw.integers(0, 256, (6, 64, 3)).astype(np.uint8)
    yield "plain", draw.integers(0, 0xF5, (7, 64, 3)).astype(np.uint8)
    long = draw.integers(32, 120, (40, 64, 3)).astype(np.uint8)
    yield "a long repeat", np.concatenate([long, draw.integers(32, 120, (1, 64, 3)).astype(np.uint8), long])
    for k in (1, 2, 3, 4, 5, 16, 17):
        yield f"{k} colours", draw.integers(0, 256, (k, 3)).astype(np.uint8)[draw.integers(0, k, (3, 64))]


@pytest.mark.parametrize("way", ["windows", "symbols"])
def test_both_ways_read_what_is_stored(way, monkeypatch):
    if way == "symbols":
        monkeypatch.setattr(webp, "_shared", lambda green, red: None)
    for name, image in _images():
        assert (webp.read_samples([webp.encode_samples(image)]) == image).all(), name


def test_choices():
    sizes = {n: (len(webp.encode_samples(x)), x.size) for n, x in _images()}
    assert sizes["repeated rows"][0] < 0.7 * sizes["plain"][0] * sizes["repeated rows"][1] / sizes["plain"][1]
    assert sizes["a long repeat"][0] < 0.6 * sizes["a long repeat"][1] * 1.25 and sizes["1 colours"][0] < 400 and sizes["16 colours"][0] < sizes["17 colours"][0]
    pixels = np.arange(100) % 20
    assert webp.copies(pixels.astype(np.uint32)) == [(20, 80, 20)] and webp.copies(np.arange(100, dtype=np.uint32)) == [] and webp.copies(np.arange(3, dtype=np.uint32)) == []


def test_features_of_stored_texts(spark, odd):
    """Every column recomputed from the encoder and the padded text."""
    rows = odd.where("doc_id is not null and doc_id < 5 or doc_id > 6")
    got = {r.id: r for r in webp.media_features(webp.store_texts(rows)).collect()}
    for i, text in rows.select("doc_id", "text").collect():
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        files = webp.encode_payload(payload)
        samples = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), sum(map(len, files)), hashlib.sha256(b"".join(files)).hexdigest(), webp.average_hash(samples))
        assert tuple(got[i])[1:] == want
