"""Periodic runs, source divergence and exact search beside plain versions, with odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corelode.llm import divergence, impact_index, periodic_runs, queries

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_runs(words):
    """(start, length, period) by walking every period over all words."""
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(12, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def plain_report(doc_id, text, planted):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(kept))


@given(st.lists(st.lists(st.integers(0, 2), max_size=50).map(lambda w: w + w[-20:] * 2), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs(texts):
    sizes = np.array([len(t) for t in texts])
    code = np.array([w for t in texts for w in t], np.int64)
    got = periodic_runs.find_runs(code, sizes) if len(code) else []
    starts = np.cumsum(sizes) - sizes
    assert [(s, e - s, p) for s, e, p in map(tuple, got)] == [(s + at, n, p) for at, t in zip(starts, texts, strict=True) for s, n, p in plain_runs(t)]
    may = periodic_runs._may_repeat(code, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
    assert all(m for m, t in zip(may, texts, strict=True) if plain_runs(t))


def test_periodic_runs(spark, odd, empty, monkeypatch):
    for planted, size in ((False, 8_000_000), (True, 500)):
        monkeypatch.setattr(periodic_runs, "BATCH_BYTES", size)
        monkeypatch.setattr(periodic_runs, "GRID", size)
        got = {r[0]: tuple(r[1:]) for r in periodic_runs.periodic_runs(odd.where("doc_id is null or doc_id not in (5, 6)"), planted=planted).collect()}
        assert got == {i: plain_report(i, t, planted) for i, t in odd.select("doc_id", "text").collect() if i not in (5, 6)}
    long = {r[0]: r for r in periodic_runs.periodic_runs(odd.where("doc_id in (5, 6)")).collect()}
    assert long[5][1:] == long[6][1:] and long[5].n_runs == 1 and long[5].period == 1954 and long[5].length == 24_000
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_periodic_runs_query(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    docs = docs[docs.text.str.len() < 3000]
    got = {r[0]: tuple(r[1:]) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert {i: got[i] for i in docs.doc_id} == {i: plain_report(i, t, True) for i, t in zip(docs.doc_id, docs.text, strict=True)}


def plain_divergence(rows, least, top):
    langs, out = {}, []
    for lang, source, text in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        langs.setdefault(lang or "", {}).setdefault(source or "", []).append(Counter(terms))
    for lang, sources in langs.items():
        df = Counter(t for docs in sources.values() for d in docs for t in d)
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: {t: sum(d[t] for d in docs) for t in kept} for s, docs in sources.items()}
        counts_all = {t: sum(c[t] for c in counts.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(counts_all)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 2])
def test_divergence(spark, odd, empty, monkeypatch, block):
    monkeypatch.setattr(divergence, "PAIR_BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 60)
    draw = np.random.default_rng(3)
    words = ["Ab", "aB", "é", "É", "zz-top", "x1y", "漢字", "the", "\x7f", "K"]
    rows = [(None if k % 7 == 0 else "en" if k % 3 else "", f"s{k % 5}" if k % 11 else None, " ".join(draw.choice(words, draw.integers(0, 9))) if k % 13 else None) for k in range(200)]
    rows += [("lone", "a", ""), ("lone", "b", None), ("solo", "a", "the the")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, source string, text string, term int, N int, value int")
    for least in (1, 30):
        got = divergence.source_divergence(docs, least, 3).collect()
        assert sorted(map(tuple, got)) == plain_divergence(rows, least, 3)
    got = divergence.source_divergence(odd, 1, 50).collect()
    assert sorted(map(tuple, got)) == plain_divergence([tuple(r) for r in odd.select("lang", "source", "text").collect()], 1, 50)
    assert divergence.source_divergence(empty).count() == 0


def test_shares_are_exact(spark):
    rows = [(10**12, 7 * 10**12, 10**6), (0, 0, 1), (3, 10, 2), (10**17, 10**18, 10**7)]
    got = spark.createDataFrame(rows, "c long, held long, V long").select(divergence._share("c")).collect()
    assert [r[0] for r in got] == [1 + (c + 5) * 10**9 // (n + 5 * v) for c, n, v in rows]


def plain_top(rows, asked, k):
    out = []
    whole = {n: (i, [int(np.floor(256 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for n, q in whole.items():
        if asked(q[0]):
            scores = [(-sum(a * b for a, b in zip(q[1], v[1], strict=False)), v[0]) for m, v in whole.items() if v[0] != q[0]]
            out += [(q[0], r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "few"), [(8192, 4096, 64), (40, 3, 0)])
def test_top_k(spark, monkeypatch, shard, block, few):
    monkeypatch.setattr(impact_index, "FEW", few)
    draw = np.random.default_rng(5)
    base = draw.normal(size=(260, 8))
    base[40:80] = base[39] + draw.normal(size=(40, 8)) / 200
    base[80:140] = base[79]
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(None, [1.0] * 8), (900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1050, []), (1100, [0.5] * 3), (1150, [-300.0] * 10), (1200, [float("inf")]), (1250, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, number string, shard int")
    got = impact_index.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=shard, block_queries=block)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 50 == 0, 5)
    assert impact_index.top_k(df.limit(0), df, 5).count() == 0 and impact_index.top_k(df, df.limit(0), 5).count() == 0
    few_rows = df.where("vec_id < 3")
    assert impact_index.top_k(few_rows, few_rows.union(few_rows), 5).count() == 6


def test_top_k_refuses_what_a_long_cannot_hold(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        impact_index.top_k(df, df).count()


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_exact_top_k"])
def test_queries_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    order = [c for c in want.columns if c not in ("value", "score")]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)
