"""Operators whose work must not grow with pairs of rows, groups held whole or repeated passes."""

import numpy as np
import pytest

from corelode.operators import checks, drill, frames, nearest, ordering, profiles, qaqc


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_match_summary_of_equal_intervals(spark):
    """Equal intervals meet once: 40,000 on either side would be 1.6e9 pairs of rows."""
    left = spark.range(40_000).selectExpr("'h' AS hole", "id AS row_id", "double(id % 4) AS `from`", "double(id % 4 + 2) AS `to`")
    right = spark.range(40_000).selectExpr("'h' AS hole", "id AS log_id", "0.5D AS `from`", "2.0D AS `to`", "if(id = 7, 'a', 'b') AS category")
    row = profiles.match_summary(left, right).first()
    assert (row.assays, row.matched, row.low, row.match_pct, row.avg_overlap_pct) == (40_000, 20_000, 0, 50.0, 62.5)
    assert (row.gaps, row.overlaps) == (0, 39_999)


def test_gaps_and_overlaps_of_repeated_rows(spark):
    rows = [("h", 0.0, 2.0), ("h", 0.0, 2.0), ("h", 2.0, 2.0), ("h", 2.0, 2.0), ("h", 5.0, 4.0), ("h", 5.0, 4.0), ("h", None, 1.0), ("g", 1.0, 2.0)]
    got = {r.hole: (r.gaps, r.overlaps) for r in drill.gaps_and_overlaps(spark.createDataFrame(rows, "hole string, from double, to double"), []).collect()}
    assert got == {"h": (2, 2), "g": (0, 0)}


def test_matched_tells_both(spark):
    draw = np.random.default_rng(5)
    spans = lambda n: [("h" + str(k % 3), k, float(a), float(a + draw.integers(1, 6))) for k, a in enumerate(draw.integers(0, 60, n))]
    left = spark.createDataFrame(spans(80) + [("none", 99, 1.0, 2.0)], "hole string, row_id long, from double, to double")
    right = spark.createDataFrame([(*r, "abc"[r[1] % 3]) for r in spans(60)] + [("h0", 500, float("-inf"), 3.0, "early")], "hole string, log_id long, from double, to double, category string")
    want = sorted(map(str, drill.combine_codes(drill.max_overlap(left, right), right).collect()))
    assert sorted(map(str, drill.matched(left, right, deep=True).collect())) == want


def test_nearest_within_crowds(spark):
    """All places lie within one radius: cells as wide as it would meet 4e8 pairs."""
    draw = np.random.default_rng(6)
    spots = draw.random((20_000, 2))
    table = lambda i, s: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(s)], f"{i} long, x double, y double")
    left = np.concatenate([spots[:300] + 0.001, spots[:300] + 0.001, [[50.0, 50.0]]])
    got = {r.a: (r.nearest_b, r.distance) for r in nearest.nearest(table("a", left), table("b", spots), "a", "b", "x", "y", radius=10.0).collect()}
    away = np.sqrt(((left[:600, None] - spots[None]) ** 2).sum(axis=2))
    assert set(got) == set(range(600)) and [got[k][0] for k in range(600)] == away.argmin(axis=1).tolist()
    assert np.allclose([got[k][1] for k in range(600)], away.min(axis=1))


@pytest.mark.parametrize("rows", [5, 6, 23, 5000])
def test_equal_bins(spark, monkeypatch, rows):
    draw = np.random.default_rng(7)
    m, d = np.round(draw.gamma(2, 2, rows), 1) + 0.1, np.round(draw.random(rows), 1)
    df = spark.createDataFrame(list(zip(m.tolist(), d.tolist(), strict=True)), "m double, d double")
    order = np.lexsort((d, m))
    each = max(3, rows // 6)
    want = [(k, m[p].min(), m[p].max(), m[p].sum(), d[p].sum(), len(p)) for k, p in enumerate(np.split(order, range(each, rows, each)))]
    for most in (10**6, 10):
        monkeypatch.setattr(ordering, "EXACT_ROWS", most)
        monkeypatch.setattr(ordering, "SLACK", 0.01)
        got = ordering.equal_bins(df, "m", "d", lambda n: max(3, n // 6)).orderBy("bin").collect()
        assert np.allclose([tuple(r) for r in got], want)


def test_box_stats_hold_no_group(spark):
    draw = np.random.default_rng(8)
    v = np.round(draw.normal(size=30_000), 3)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [(None, 1.0), (None, 2.0), ("b", None)], "g string, v double")
    found = checks.box_stats(df, "v", ["g"])
    assert "Window" not in _plan(found)
    got = {r.g: r for r in found.collect()}
    s = np.sort(v)
    assert [got["a"][c] for c in ("n", "q1", "median", "q3", "low", "high")] == [30_000, s[7500], s[15_000], s[22_500], s[0], s[-1]]
    assert set(got) == {"a", None} and got[None].median == 2.0


def test_duplicate_precision_holds_no_kind(spark):
    pairs = spark.createDataFrame([(10.0, 12.0, "x"), (10.0, 10.0, "x"), (1.0, 1.0, "x"), (0.0, 0.0, None)], "value double, value_dup double, kind string")
    found = qaqc.duplicate_precision(pairs, 1.0, by=["kind"])
    assert "median(" not in _plan(found) and "Relation" not in _plan(found)
    got = {r.kind: r for r in found.collect()}
    assert got["x"].pairs == 3 and got["x"].low_pairs == 1 and got["x"].median_rpd == pytest.approx(400 / 22 / 2) and got[None].median_rpd is None


def test_pairs_work_out_bases_once(spark):
    samples = spark.createDataFrame([(1, "S1"), (2, "S1-DUP"), (3, "S1_rep"), (4, "S1-QC"), (5, "T2A"), (6, "T2B")], "row long, id string")
    found = qaqc.all_pairs(samples, "id")
    assert _plan(found).count("DUP$") <= 2
    assert sorted((r.original_row, r.duplicate_row, r.kind) for r in found.collect()) == [(1, 2, "field_duplicate"), (1, 3, "pulp_duplicate"), (1, 4, "core_duplicate"), (5, 6, "field_duplicate")]


def test_complete_works_a_column_out_once(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),), (-2.0,)], "v double")
    kept = frames.complete(rows.selectExpr("exp(ln(v + 9)) - 9 AS v", "v AS w").where("w is not null or w is null"), ["v"])
    assert _plan(kept).split("Filter")[1].split("+-")[0].count("LOG") <= 1 and _plan(kept).lower().count("isnan") == 0
    assert sorted(r.w for r in frames.complete(rows.withColumn("w", rows.v), ["v"]).collect()) == [-2.0, 1.0]
