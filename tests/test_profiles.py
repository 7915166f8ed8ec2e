"""Profiles, roles, ranks and places on small tables; a stream with late rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelode.operators import profiles
from corelode.streaming import control


def test_profile_and_roles(spark):
    df = spark.createDataFrame([("a", "s1", 1.0, None), ("b", " ", 2.0, None), ("a", None, None, 3.0)], "BHID string, SampleID string, East double, X double")
    profile = profiles.column_profile(df)
    assert {r.column: (r.known, r.missing, r.role) for r in profile.collect()} == {"BHID": (3, 0, "HoleID"), "SampleID": (1, 2, "ID"), "East": (2, 1, "East"), "X": (1, 2, "East")}
    best = {r.role: (r.column, r.score) for r in profiles.best_roles(profile).collect()}
    assert best["East"][0] == "East" and best["East"][1] == pytest.approx(90 * 2 / 3 * 0.98) and "ID" not in best
    assert profiles.best_roles(profile, {"East": 40, "X": 100}).where("role = 'East'").count() == 0
    assert profiles.column_profile(df.limit(0)).count() == 4


def test_loose_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ("<0.5", "> 1,200", "NA", "--", "12abc", "", None, " 7 ")], "t string")
    assert [r[0] for r in df.select(profiles.loose_number(F.col("t"))).collect()] == [0.5, 1200, None, None, None, None, None, 7]


def test_ranks(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (5.0, "z"), (None, None), (float("nan"), "q")], "v double, c string")
    assert [r["rank"] for r in profiles.linear_rank(df, "v").collect()] == [0, 0.5, 1, None, None]
    assert [r["rank"] for r in profiles.linear_rank(df, "v", 2.0, 4.0).collect()] == [0, 0.5, 1, None, None] and profiles.linear_rank(df.limit(1), "v").first()["rank"] == 0.5
    assert [r[0] for r in df.select(profiles.range_rank(F.col("v"), [(0.0, 2.0), (2.0, 4.0), (4.0, 4.5)])).collect()] == [0, 0.5, 1, None, None]
    assert [r[0] for r in df.select(profiles.category_rank(F.col("c"), ["x", "y", "z"])).collect()] == [0, 0.5, 1, None, 0.5]


def test_match_summary(spark):
    left = spark.createDataFrame([("a", 1, 0.0, 2.0), ("a", 2, 2.0, 4.0), ("a", 3, 4.0, 6.0), ("b", 4, 0.0, 1.0)], "hole string, row_id int, from double, to double")
    right = spark.createDataFrame([("a", 1, 0.0, 2.0, "x"), ("a", 2, 3.5, 5.0, "y"), ("a", 3, 4.5, 9.0, "y"), ("c", 9, 0.0, 1.0, "z")], "hole string, log_id int, from double, to double, category string")
    got = {r.hole: r for r in profiles.match_summary(left, right).collect()}
    assert (got["a"].matched, got["a"].low, got["a"].match_pct, got["a"].gaps, got["a"].overlaps) == (3, 1, 100.0, 1, 1) and (got["b"].matched, got["b"].match_pct, got["b"].gaps) == (0, 0.0, 0) and "c" not in got
    assert got["a"].avg_overlap_pct == pytest.approx(round((100 + 25 + 75) / 3, 1))


def test_ratio_ranking(spark):
    draw = np.random.default_rng(1)
    x, g = np.exp(draw.normal(size=(80, 3))), np.arange(80) % 3
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(g, x, strict=True)] + [(0, 0.0, 1.0, 1.0)], "g int, a double, b double, c double")
    got = {r.ratio: r for r in profiles.ratio_ranking(df, ["a", "b", "c"], "g").collect()}
    logs = {"a/b": np.log(x[:, 0] / x[:, 1]), "a/c": np.log(x[:, 0] / x[:, 2]), "b/c": np.log(x[:, 1] / x[:, 2])}
    total = sum(v.var(ddof=1) for v in logs.values())
    for name, v in logs.items():
        rest = sum(w for n, w in logs.items() if n != name)
        b = sum((g == k).sum() * (v[g == k].mean() - v.mean()) ** 2 for k in range(3))
        assert np.allclose((got[name].variance, got[name].contributed, got[name].explained, got[name].between), (v.var(ddof=1), 100 * v.var(ddof=1) / total, 100 * np.corrcoef(v, rest)[0, 1] ** 2, 100 * b / (v.var() * 80)))
    assert profiles.ratio_ranking(df, ["a", "b", "c"], top=1).count() == 1


def test_places(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 20.0), (None, 5.0), (float("nan"), 1.0)], "x double, y double")
    box = profiles.extent(df, "x", "y").first()
    assert (box.n, box.x0, box.y0, box.x1, box.y1, box.cx, box.cy) == (2, -0.5, -1, 10.5, 21, 5, 10) and profiles.extent(df.limit(0), "x", "y").first().x0 is None
    assert profiles.inside_extent(df, "x", "y", (0.0, 0.0, 5.0, 5.0)).count() == 1 and profiles.sample_size(20_000) is None and profiles.sample_size(30_000) == 7_500 and profiles.sample_size(10**6) == 10_000
    rows = profiles.spider_rows(spark.createDataFrame([(1, 0.474, None)], "id int, la double, q double"), ["id"], {"La": "la", "Q": "q"}, "mcdonough-sun-1995").orderBy("place").collect()
    assert rows[0].value == pytest.approx(2) and rows[1].value is None
    told = profiles.plot_ranges(df, ["x"]).first()
    assert (told.low, told.high, told.low_positive) == (0, 10, 10)
    steps = profiles.downhole_profile(spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), ("a", None, 9.0)], "h string, d double, v double"), "h", "d", ["v"]).orderBy("d").collect()
    assert [r.thickness for r in steps] == [2, None] and [r.smooth for r in steps] == [3, 3]


def test_stream_with_late_rows(spark, tmp_path):
    at = lambda h, d=1: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, g string, value double"
    told = [[(at(1), "a", 1.0), (at(2), "a", 9.0)], [(at(1, 5), "a", 1.0)], [(at(3), "a", 1.0), (at(2, 5), "a", 1.0)], [(at(5, 9), "a", 1.0)], [(at(6, 9), "a", 1.0)]]
    limits = spark.createDataFrame([("a", 1.0, 1.0)], "g string, centre double, sd double")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = control.failures_by_window(control.chart_status(stream, limits, "g", "value"), "ts", "g", "1 day", "1 day")
    query = out.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in told:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    query.stop()
    got = {(r.window.start.day, r.status): r["count"] for r in spark.table("late").collect()}
    # The row of the first day that came after the fifth was seen is too late for its window; that of the fifth day is not.
    assert got == {(1, "pass"): 1, (1, "fail"): 1, (5, "pass"): 2}
