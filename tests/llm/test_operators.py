"""Each operator beside a brute-force version, an exact round trip or held-out accuracy, with odd inputs."""

import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest
from pyspark.sql import functions as F

from corelode.llm import bpe, components, langid, line_dedup, lm, packing, quality, simhash, token_counts, vector_graph, webp

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from(list("ab'st re<|>=.,!?#é*ÉßΣς İ̸̈ \x1c\n\t١9漢😀▁")) | st.characters(exclude_categories=["Cs"]), max_size=80)


@given(TEXT, st.integers(2, 24), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_spliced_counts(text, chunk, overlap):
    assert token_counts.count_tokens(text, PIECE, chunk, overlap)[0] == len(token_counts._model(PIECE).encode(text))


def test_token_counts(odd, empty):
    got = token_counts.token_counts(odd, PIECE, chunk=2000).toPandas()
    assert len(got) == odd.count() and token_counts.token_counts(empty, PIECE).count() == 0
    for i, t in odd.select("doc_id", "text").collect():
        row = got[got.doc_id.isna() if i is None else got.doc_id == i].iloc[0]
        assert row.n_tokens == len(token_counts._model(PIECE).encode(t or "")) and row.n_bytes == len((t or "").encode())


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=150, deadline=None)
def test_fragments(texts):
    library, own = bpe.encoder(WORD).library, bpe.encoder(WORD)
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe(odd, empty):
    got = bpe.bpe_encode(odd, WORD, decode=True)
    assert got.count() == odd.count() and bpe.bpe_encode(empty, WORD).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_plan_places_every_piece(n):
    lengths = np.random.default_rng(n).integers(1, 4097, n)
    histogram = np.bincount(lengths, minlength=4097)
    used, load = np.zeros(4097, int), {}
    for length, _, repeats, sequence, offset in packing.plan(histogram):
        used[length] += repeats
        for s in range(sequence, sequence + repeats):
            load.setdefault(s, []).append((offset, length))
    assert (used == histogram).all()
    for parts in load.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing(odd, empty):
    got = packing.pack_documents(odd, WORD).toPandas()
    assert set(got.doc_id.dropna()) == set(range(11)) and got.groupby("sequence_id").length.sum().max() <= 4096
    ids = np.array(bpe.encoder(WORD).library.encode(odd.where("doc_id = 5").first().text, add_special_tokens=False).ids + [1], "<u4").tobytes()
    for r in got[got.doc_id == 5].itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    assert packing.pack_documents(empty, WORD).count() == 0


def test_lm(odd, empty):
    words = re.compile(rb"[^\x20\x09-\x0d]+")
    told = [(r.doc_id, words.findall((r.text or "").lower().encode())) for r in odd.collect()]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in told}
    counts = Counter(w for i, ws in told if not held[i] for w in [*ws, None])
    total, kinds = sum(counts.values()), len(counts)
    first = None
    for parts in (1, 7):
        got = {r.doc_id: r for r in lm.score_texts(odd.repartition(parts)).collect()}
        assert len(got) == odd.count()
        for i, ws in told:
            seen = [counts[w] for w in [*ws, None]]
            row = got[i]
            assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(seen), sum(c > 0 for c in seen), total)
            assert np.isclose(row.base_score, sum(np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in seen))
        first = first or got
        assert all(np.isclose(got[i].score, first[i].score, rtol=1e-6) and got[i].score < 0 for i in got)
    assert lm.score_texts(empty).count() == 0


def test_lm_gains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_texts(docs).where("held_out").toPandas()
    assert got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum() + 0.1


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, lengths):
        """A prefix code, each length written as itself with a flat 4-bit code."""
        self.put(0, 1), self.put(15, 4)
        for k in webp.LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        flat = webp.reversed_codes(np.array([4] * 16))
        for n in lengths:
            self.put(int(flat[n]), 4)

    def one(self, symbol):
        self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(symbol, 8)

    def image(self, pixels, cache=0, main=False, ops=None):
        """Literals, or ('copy', length prefix, distance prefix) and ('cache', k) where ``ops`` says so."""
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(0, 1)
        green = np.array([9] * 256 + [9] * 24 + [9] * (1 << cache if cache else 0))
        green = np.r_[green, []].astype(int)
        full = 512 - len(green)  # shorten some codes until the code is complete
        green[:full] = 8
        eight = np.full(256, 8)
        self.code(green), self.code(eight), self.code(eight), self.code(eight)
        far = np.full(40, 6)
        far[:24] = 5
        far[24:] = 6
        self.code(far)
        g, e, d = webp.reversed_codes(green), webp.reversed_codes(eight), webp.reversed_codes(far)
        for op in ops if ops is not None else [int(p) for p in pixels]:
            if isinstance(op, tuple) and op[0] == "copy":
                self.put(int(g[256 + op[1]]), int(green[256 + op[1]])), self.put(int(d[op[2]]), int(far[op[2]]))
            elif isinstance(op, tuple):
                self.put(int(g[280 + op[1]]), int(green[280 + op[1]]))
            else:
                for v, t, n in ((op >> 8 & 255, g, green), (op >> 16 & 255, e, eight), (op & 255, e, eight), (op >> 24, e, eight)):
                    self.put(int(t[v]), int(n[v]))

    def payload(self, w, h):
        lead = 0x2F | (w - 1) << 8 | (h - 1) << 22
        return np.packbits([lead >> k & 1 for k in range(40)] + self.bits, bitorder="little").tobytes()


def _pixels(w, h, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, w * h, dtype=np.uint32)


def test_webp_references_and_cache():
    pixels = [0xFF102030, 0xFF405060]
    slot = (webp.CACHE_FACTOR * pixels[0] & 0xFFFFFFFF) >> 30
    w = Writer()
    w.put(0, 1), w.image(None, cache=2, main=True, ops=[*pixels, ("copy", 3, 1), ("cache", slot)])
    got = webp.decode_vp8l(w.payload(7, 1)).ravel().tolist()
    same = slot == (webp.CACHE_FACTOR * pixels[1] & 0xFFFFFFFF) >> 30  # then the later pixel took the slot
    assert got == [pixels[0], *[pixels[1]] * 5][: len(got) - 1] + [pixels[1] if same else pixels[0]]


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictor(mode):
    pixels = _pixels(5, 6, mode).tolist()
    rest = []
    for k, p in enumerate(pixels):
        guess = webp.guesses(lambda x, y: mode, 5, 6, pixels, k)
        rest.append(sum(((p >> s) - (guess >> s) & 255) << s for s in (0, 8, 16, 24)))
    w = Writer()
    w.put(1, 1), w.put(0, 2), w.put(1, 3), w.image([0xFF000000 | mode << 8])
    w.put(0, 1), w.image(rest, main=True)
    # one 8 x 8 block holds the whole image
    assert webp.decode_vp8l(w.payload(5, 6)).ravel().tolist() == pixels


def test_webp_green_cross_and_palette():
    pixels = _pixels(4, 3)
    green = pixels >> 8 & 255
    less = pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) - green & 255) << 16 | (pixels - green & 255)
    w = Writer()
    w.put(1, 1), w.put(2, 2), w.put(0, 1), w.image(less, main=True)
    assert (webp.decode_vp8l(w.payload(4, 3)).ravel() == pixels).all()
    w = Writer()
    w.put(1, 1), w.put(1, 2), w.put(0, 3), w.image([0xFF000020]), w.put(0, 1), w.image([0xFF1040F0], main=True)
    assert webp.decode_vp8l(w.payload(1, 1))[0, 0] == 0xFF000000 | (0x10 + (0x20 * 0x40 >> 5) & 255) << 16 | 0x40F0
    palette, index = np.array([0xFF000001, 0xFF0A0000, 0xFFFFFFFF], np.uint32), [0, 2, 1, 1, 0, 2]
    steps = [int(sum(((int(palette[k]) >> s) - (int(palette[k - 1]) >> s if k else 0) & 255) << s for s in (0, 8, 16, 24))) for k in range(3)]
    w = Writer()
    w.put(1, 1), w.put(3, 2), w.put(2, 8), w.image(steps), w.put(0, 1)
    packed = [sum(v << 2 * k for k, v in enumerate(row)) << 8 for row in (index[:3], index[3:])]
    w.image(packed, main=True)
    assert (webp.decode_vp8l(w.payload(3, 2)).ravel() == palette[index]).all()


def test_media(odd, empty):
    got = webp.media_features(webp.store_texts(odd)).toPandas()
    assert len(got) == odd.count()
    for i, t in odd.where("doc_id is not null").select("doc_id", "text").collect():
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        row = got[got.id == i].iloc[0]
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-16:])
    arrays = {r.id: r for r in webp.pixel_arrays(webp.store_texts(odd)).collect()}
    assert all(r.height * r.width * 3 == len(r.samples) for r in arrays.values()) and bytes(arrays[3].samples).decode().startswith("The cat sat")
    assert webp.media_features(webp.store_texts(empty)).count() == webp.pixel_arrays(webp.store_texts(empty)).count() == 0
    assert struct.unpack("<I", webp.encode_payload(b" " * 192)[0][4:8])[0] % 2 == 0


def _reachable(n, linked):
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_simhash_links(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[b ^ np.uint64(1 << int(draw.integers(64))) ^ np.uint64(1 << int(draw.integers(64))) for b in base for _ in range(3)]], axis=None))
    rows = spark.createDataFrame([(int(f.view(np.int64)), k) for k, f in enumerate(fps)], "fp long, rep long")
    want = _reachable(len(fps), lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b])) <= 3)
    for size in (1, 4096):  # every shared shard dealt again, and none
        got = {r[0]: r[1] for r in components.connected_components(simhash.near_links(rows, shard_rows=size)).collect()}
        assert [got.get(k, k) for k in range(len(fps))] == want


def test_simhash(odd, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0 and got[0].fingerprint == "0" * 16
    assert got[6].component_id == 5 and None in got and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {0, 5, None} and 6 not in {r.doc_id for r in kept.collect()}


def test_whole_chains():
    draw = np.random.default_rng(0)
    emitted, moves = draw.normal(size=(9, 3)), draw.normal(size=(3, 3))
    chains = [draw.integers(0, 9, n) for n in (7, 1, 4, 8, 3)]
    pieces = np.array([-(-len(c) // 3) for c in chains])
    start = np.cumsum(pieces) - pieces
    grid = np.full((pieces.sum(), 3), -1)
    for k, c in enumerate(chains):
        for i, v in enumerate(c):
            grid[start[k] + i // 3, i % 3] = v
    got = langid.whole_chains(emitted, moves, grid, start, pieces)
    for k, c in enumerate(chains):
        want = np.zeros((len(c), 3))
        for path in itertools.product(range(3), repeat=len(c)):
            weight = np.exp(sum(emitted[v, p] for v, p in zip(c, path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            want[np.arange(len(c)), path] += weight
        assert np.allclose([got[start[k] + i // 3, i % 3] for i in range(len(c))], want / want.sum(axis=1, keepdims=True))


def test_langid(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs, per_language=60)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    assert (got.lang == got.lang_pred)[held].mean() > 0.97
    odd_rows = {r.doc_id: r for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert odd_rows[0].lang_pred == odd_rows[1].lang_pred == "und" and odd_rows[5].lang_pred == "en"
    assert langid.predict(odd, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.score(docs, quality.fit(docs, labels.where(~apart))).join(labels.where(apart), "doc_id").toPandas()
    assert (got.score[got.quality == 1] >= 0.5).mean() > 0.97 and (got.score[got.quality == 0] < 0.5).mean() > 0.95
    assert (got.toxic_score[got.toxic == 0] < 0.5).mean() > 0.95 and (got.toxic_score[got.toxic == 1] >= 0.5).mean() > 0.6
    few = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, few)
    assert quality.score(odd, model).count() == odd.count() and quality.score(empty, model).count() == 0
    assert quality.score(odd, quality.fit(empty, labels)).where("not kept").count() == 0


def _lines_to_go(rows):
    """By brute force: {(id, text): numbers of lines that equal or resemble an earlier line}; rows by id, then in the order given."""
    lines, sets, want = set(), [], {}
    for i, t in rows:
        gone = want.setdefault((i, t), [])
        for k, line in enumerate(t.lower().split("\n")):
            own = set(line.split())
            if own:
                if line in lines or any(len(own & s) / len(own | s) >= 0.8 for s in sets):
                    gone.append(k)
                lines.add(line)
                sets.append(own)
    return want


def test_lines(spark, odd, empty):
    rows = sorted((r.doc_id, r.text) for r in odd.where("doc_id is not null and text is not null").collect())
    want = _lines_to_go(rows)
    got = {r.doc_id: r for r in line_dedup.line_report(odd).collect()}
    assert got[0].n_lines == 0 and {i: r.removed_lines for i, r in got.items() if i} == {i: v for (i, _), v in want.items() if i}
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(odd).collect()}
    assert len(clean) == odd.count() and clean[0] is None and clean[None] == "an id is missing here"
    assert all(clean[i] == "\n".join(v for k, v in enumerate(t.split("\n")) if k not in want[i, t]) for i, t in rows)
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_repeated_ids(spark):
    texts = ["one two three\nfour five six", "one two three\nseven eight nine", "one two three\nseven eight nine"]
    docs = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[2])], "doc_id long, text string")
    clean = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    own = [t for i, t in clean if i == 7]
    # Equal rows of one id are one document; each line that no other row has stays.
    assert len(clean) == 4 and (8, "") in clean
    assert sum("four five six" in t for t in own) == 1 and sum("seven eight nine" in t for t in own) == 2
    assert sum("one two three" in t for t in set(own)) == 1


def test_lines_of_many_copies(spark, monkeypatch):
    draw = np.random.default_rng(9)
    base = [f"word{v}" for v in draw.integers(400, size=40)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in draw.choice(40, int(draw.integers(0, 9)), replace=False):
            words[at] = f"other{draw.integers(2000)}"
        rows.append((i, " ".join(words) + "\nof this and that " + str(i % 4)))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), _lines_to_go(rows)
    for group in (2, 512):
        monkeypatch.setattr(line_dedup, "GROUP", group)
        got = {r.doc_id: r.removed_lines for r in line_dedup.line_report(docs).collect()}
        assert got == {i: v for (i, _), v in want.items()}


def test_rarity_of_lines(spark):
    """Words that do not stand out of their buckets are ordered by length, the longest first; frequent ones come last."""
    words = [f"{chr(97 + k % 26)}{k}" + "y" * (k % 9) for k in range(4000)]
    rows = [(k, " ".join(["frequent_but_long", *words[10 * k : 10 * k + 10]])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = line_dedup.rarity_levels(docs)
    assert len(levels) == 1 << line_dedup.BUCKET_BITS and max(levels) - 33 > 20

    def key(word):
        h = xxh64_intdigest(word, 42)
        return levels[h & 0xFFFF] - 33 << 58 | 63 - len(word) << 52 | h >> 12

    for r in line_dedup.class_sets(docs, "doc_id", "text", line_dedup.SIMILARITY).collect():
        own = sorted(rows[r.id][1].split(), key=key)
        assert r.n == len(own) and r.prefix == [key(w) for w in own[:3]] and own[-1] == "frequent_but_long"
        alone = [w for w in own if key(w) >> 58 == key(own[0]) >> 58]
        assert len(own[0]) == max(map(len, alone))


def test_odd_vectors(spark):
    big, small, rows = [1e200, 2e200, 0.0], [1e-200, 2e-200, 0.0], []
    rows = [(1, big, 0), (2, small, 0), (3, [1.0, 2.0, 0.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (6, [1.0, 2.0, 0.0], None), (None, [1.0, 2.0, 0.0], 0), (3, [0.0, 0.0, 5.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit("clash")).withColumn("shard", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_graph.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), None: (0, None)} and vector_graph.near_duplicates(df).count() == len(rows)


def test_many_shards(spark, monkeypatch):
    draw = np.random.default_rng(8)
    monkeypatch.setattr(vector_graph, "SHARD_VECTORS", 60)
    base = draw.normal(size=(250, 24))
    x = np.concatenate([base, base[:80] + draw.normal(size=(80, 24)) * 0.05, base[[0]] + draw.normal(size=(120, 24)) * 0.03])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.98).sum()) - len(x)
    found = sum(r.n_links for r in vector_graph.near_duplicates(df).collect())
    assert 0.98 * true <= found <= true


def test_vectors(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(30, 16))
    x = np.concatenate([base, *[base[:10] + draw.normal(size=(10, 16)) * s for s in (0.02, 0.05, 0.1)]])
    rows = [(k, v.tolist(), k % 2 if k < 60 else None) for k, v in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = lambda a, b: a != b and a < 60 and b < 60 and a % 2 == b % 2 and unit[a] @ unit[b] >= 0.98
    want = _reachable(60, linked)
    assert len(got) == len(rows) and [got[k].component_id for k in range(60)] == want
    assert all(got[k].n_links == sum(linked(k, j) for j in range(60)) for k in range(60))
    assert all(got[k].n_links == 0 and got[k].kept for k in (100, 101, 102, 103))
    assert vector_graph.recall(df, vector_graph.links(df), every=5) >= 0.9
    assert vector_graph.near_duplicates(df.limit(0)).count() == 0


def test_equal_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(3, 16))
    near = base[[0]] + draw.normal(size=(60, 16)) * 0.03
    x = np.concatenate([np.repeat(base[[0]], 400, axis=0) * np.repeat([1.0, 2.0], 200)[:, None], near, near[:20], np.repeat(base[[1]], 70, axis=0), base[[2]]])
    rows = [(k, v.tolist(), k % 7 == 0) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label boolean")
    unit, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(len(x)) % 7 == 0
    like = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df).collect()}
    assert [got[k].n_links for k in range(len(x))] == like.sum(axis=1).tolist()
    assert [got[k].component_id for k in range(len(x))] == _reachable(len(x), lambda a, b: like[a, b])
    assert {tuple(r) for r in vector_graph.links(df).collect()} == set(zip(*(v.tolist() for v in np.nonzero(like)), strict=True))


def test_keep_one_near_copies(spark):
    draw = np.random.default_rng(6)
    texts = []
    for _ in range(40):
        words = draw.integers(5000, size=int(draw.integers(60, 300)))
        texts.append(words)
        for share in (0.01, 0.02, 0.03, 0.06, 0.15):
            copy = words.copy()
            at = draw.choice(len(words), max(1, int(share * len(words))), replace=False)
            copy[at] = draw.integers(5000, 10_000, size=len(at))
            texts.append(copy)
    texts = [" ".join(f"w{v}" for v in words) for words in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    linked = lambda a, b: a // 6 == b // 6 and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4
    want = _reachable(len(texts), linked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.jaccard_groups(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want)


def test_short_lines(spark, tmp_path):
    import corpus_pipeline
    from corelode.llm import queries

    texts = ["Les.\n\nAnd ornd.\nred blue green grey pink", "Les.\nornd. and\n\nblue red green grey\nred blue green", "les.\nred blue green\nred blue\nred blue"]
    rows, sets, want = list(enumerate(texts)), [], {}
    for i, t in rows:
        want[i] = []
        for k, own in enumerate(set(line.lower().split()) for line in t.split("\n")):
            if own and any(len(own & s) / len(own | s) >= 0.8 for s in sets):
                want[i].append(k)
            sets.append(own)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed_lines for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(map(str, v)) for i, v in want.items()}
    clean = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()}
    assert clean == {i: "\n".join(line for k, line in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}


def test_repeated_ids(spark, odd):
    more = odd.where("doc_id is not null").union(odd.where("doc_id = 4").withColumn("text", F.lit("another text of that id"))).union(odd.where("doc_id = 9"))
    rows = more.count()
    assert token_counts.token_counts(more, PIECE).count() == bpe.bpe_encode(more, WORD, decode=True).count() == rows
    assert lm.score_texts(more).count() == webp.media_features(webp.store_texts(more)).count() == rows
    assert langid.predict(more, langid.fit(more)).count() == quality.score(more, quality.fit(more, odd.selectExpr("doc_id", "1 as quality", "0 as toxic"))).count() == rows
    assert simhash.near_duplicates(more).count() == line_dedup.dedup_lines(more).count() == rows
    assert packing.pack_documents(more, WORD).where("piece = 0").count() == rows
