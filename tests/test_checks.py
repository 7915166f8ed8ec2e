"""Checks, readers, small-sample tails and compositions on small tables and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelode.operators import checks, compose, qaqc, robust, spatial, stats
from corelode.sources import tables


def test_arithmetic(spark):
    df = spark.createDataFrame([("1", 2.0, None), ("x", 0.0, None), ("3", None, float("nan")), ("inf", 1.0, 4.0)], "a string, b double, c double")
    got = df.select(checks.ratio("a", "b").alias("r"), checks.total(["b", "c"]).alias("t"), checks.transformed("b", lambda v: F.ln(v)).alias("l")).collect()
    assert [r.r for r in got] == [0.5, None, None, None] and [r.t for r in got] == [2, 0, None, 5] and [r.l for r in got] == [pytest.approx(math.log(2)), None, None, 0]


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, -1.0, 99.0), (3, None, 1.0), (4, 0.0, 0.0)], "id int, a double, b double")
    rules = [checks.Rule("positive", "a", "positive"), checks.Rule("sum", "a", "sum", "warning", high=50, columns=("a", "b")), checks.Rule("own", "b", "custom", condition=F.col("b") < 90), checks.Rule("low", "a", "range", low=-5)]
    found = {(r.id, r.rule) for r in checks.violations(df, rules, ["id"]).collect()}
    assert found == {(2, "positive"), (4, "positive"), (2, "sum"), (2, "own")}
    assert {r.rule: (r.broken, r.valid) for r in checks.rule_report(df, rules).collect()} == {"positive": (2, False), "sum": (1, True), "own": (1, False), "low": (0, True)}
    assert checks.violations(df, [], ["id"]).count() == 0
    with pytest.raises(ValueError):
        checks.violations(df, [checks.Rule("x", "a", "odd")], ["id"])


def test_oxides_and_units(spark):
    assert checks.oxide_column(["sio2", "Al2O3_pct", "MgO wt%"], "MgO") == "MgO wt%" and checks.oxide_column(["x"], "MgO") is None
    df = spark.createDataFrame([(60.0, 38.0, None), (10.0, None, None), (70.0, 50.0, None)], "SiO2 double, Al2O3 double, none double")
    assert [r.major_status for r in checks.major_sum(df).collect()] == ["ok", "below", "above"]
    assert [r.unit for r in checks.unit_guess(df, ["SiO2", "none"]).collect()] == ["wt%", None]


def test_boxes_and_bins(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 7.0), (None, 1.0), ("c", None)], "g string, v double")
    got = {r.g: r for r in checks.box_stats(df, "v", ["g"]).collect()}
    assert set(got) == {"a", "b", None} and (got["a"].q1, got["a"]["median"], got["a"].q3, got["a"].whisker_high, got["a"].outliers) == (2, 3, 4, 4, 1) and got["b"].q1 == 7
    bins = checks.indicator_histogram(df.where("g = 'a'"), "v", [(50, "high"), (0, "low")]).orderBy("bin").collect()
    assert [b.n for b in bins] == [4, 0, 1] and [b.band for b in bins] == ["low", "high", "high"]
    assert checks.indicator_histogram(df.limit(0), "v").count() == 0 and checks.caption(df.where("g = 'a'"), "v").first()["median"] == 3 and checks.caption(df.limit(0), "v").first().n == 0


@pytest.mark.parametrize("n", [3, 4, 5, 8, 30, 102, 110])
def test_tail_of_correlation(spark, n):
    draw = np.random.default_rng(n)
    x = draw.normal(size=n)
    y = 0.4 * x + draw.normal(size=n)
    got = stats.correlation_p(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), ["x", "y"]).first()
    t, free = abs(got.r) * math.sqrt((n - 2) / (1 - got.r**2)), n - 2
    at = np.linspace(t, t + 4000, 4_000_001)
    dense = math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(free * math.pi) * (1 + at**2 / free) ** (-(free + 1) / 2)
    assert got.p == pytest.approx(2 * np.trapezoid(dense, at), abs=2e-3 if n > 102 or n == 3 else 1e-5)


def test_zero_modes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 4.0), (float("nan"), -1.0)], "a double, b double")
    told = lambda *a, **k: [tuple(r) for r in compose.replaced(df, ["a", "b"], *a, **k).collect()]
    assert told("half-min") == [(1, 0.5), (0.5, 4), (0.5, 0.5)] and told("small-constant") == [(1, 0.65), (0.65, 4), (0.65, 0.65)] and told("custom") == [(1, 0.001), (0.001, 4), (0.001, 0.001)]
    assert told("half-dl", limits={"b": 0.2}) == [(1, 0.1), (0.5, 4), (0.5, 0.1)] and told("small-constant", 0.3)[0] == (1, 0.3)
    none = compose.replaced(spark.createDataFrame([(0.0,)], "a double"), ["a"]).first()
    assert none.a == 0.0005


def test_log_ratio_axes(spark):
    x = np.exp(np.random.default_rng(1).normal(size=(60, 4)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(0.0, 1.0, 1.0, 1.0)], "p double, q double, r double, s double")
    c = np.log(x) - np.log(x).mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.cov(c.T))
    got = compose.log_ratio_analysis(df, ["p", "q", "r", "s"]).toPandas()
    for k in (1, 2, 3):
        own = got[got.component == k]
        assert np.allclose(np.abs(own.loading), np.abs(vectors[:, -k])) and np.allclose(own.variance_pct, 100 * values[-k] / values.sum())
    assert compose.log_ratio_analysis(df.limit(0), ["p", "q"]).count() == 0
    ranking = {r.reference: r.correlation for r in compose.reference_ranking(df, ["p", "q", "r", "s"]).collect()}
    i, j = np.triu_indices(60, 1)
    exact = np.linalg.norm(c[i] - c[j], axis=1)
    for k, name in enumerate("pqrs"):
        alr = np.delete(np.log(x) - np.log(x)[:, [k]], k, axis=1)
        assert ranking[name] == pytest.approx(np.corrcoef(exact, np.linalg.norm(alr[i] - alr[j], axis=1))[0, 1])
    assert compose.matched_columns(["Cu", "Zn", "Q"], ["CU", "Zn_ppm"]) == {"Cu": "CU", "Zn": "Zn_ppm"}


def test_adjusted(spark):
    draw = np.random.default_rng(2)
    x, z = draw.normal(size=100), draw.normal(size=100)
    y = 5 + 2 * x - 3 * z
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y, strict=True)] + [(None, 1.0, 1.0)], "x double, z double, y double")
    made, lines = robust.adjusted(df, "y", ["x", "z"], "ols")
    assert made.where("x is null").first().adjusted is None and lines.count() == 2
    got = made.where("x is not null").toPandas()
    b, a = np.polyfit(x, y, 1)
    r = y - b * x - a
    b, a = np.polyfit(z, r, 1)
    assert np.allclose(got.residual, r - b * z - a) and np.allclose(got.adjusted - got.residual, np.append(y, 1.0).mean())


def test_recommendations(spark):
    table = "element string, standard_pct double, blank_pct double, duplicate_pct double, score double, grade string"
    bad = spark.createDataFrame([("Au", 70.0, 95.0, None, 50.0, "F"), ("Cu", 99.0, 80.0, 70.0, 65.0, "D")], table)
    assert {r.finding: r.elements for r in qaqc.recommendations(bad).collect()} == {"poor accuracy of standards": ["Au"], "contaminated blanks": ["Cu"], "poor precision of duplicates": ["Cu"], "failing grade": ["Au"]}
    good = spark.createDataFrame([("Au", 99.0, 99.0, 99.0, 99.0, "A")], table)
    assert qaqc.recommendations(good).first().finding == "satisfactory" and qaqc.overall_grade(good).first().grade == "A" and qaqc.overall_grade(good.limit(0)).first().grade == "F"


def test_triangle(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (5.0, 0.0, 0.0), (0.0, 0.0, 2.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    x, y = spatial.ternary_to_plane(F.col("a"), F.col("b"), F.col("c"))
    placed = df.select(x.alias("x"), y.alias("y"))
    assert np.allclose(placed.collect(), [(0.5, 0.28867513), (0.5, 0.8660254), (1, 0), (0.5, 0.289)])
    back = placed.select(*spatial.plane_to_ternary(F.col("x"), F.col("y"))).collect()
    assert np.allclose(back[0], 100 / 3) and np.allclose(back[1], (100, 0, 0)) and np.allclose(back[2], (0, 0, 100))
    square = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 2.0, 0.0), ("s", 3, 2.0, 2.0), ("s", 4, 0.0, 2.0), ("line", 1, 0.0, 0.0), ("line", 2, 4.0, 0.0)], "k string, o int, x double, y double")
    got = {r.k: r for r in spatial.polygon_measures(square, ["k"], "o", "x", "y").collect()}
    assert (got["s"].area, got["s"].cx, got["s"].cy) == (4, 1, 1) and (got["line"].area, got["line"].cx) == (0, 2)


@pytest.mark.parametrize(("text", "encoding", "want"), [
    ("a,b\n1,2\n3,4\n", "utf-8", [("1", "2"), ("3", "4")]), ("a;b\n1,5;x\n2,5;NA\n", "utf-8", [("1,5", "x"), ("2,5", None)]), ("a\tb\n1\té\n", "latin-1", [("1", "é")]), ("Report of today\n\na,b\n1,2\n3,4\n", "utf-8", [("1", "2"), ("3", "4")]),
    ("made by\nsomebody\na|b\n1|2\n", "utf-8", [("1", "2")]), ("a   b\n1   x y\n2   z z\n", "utf-8", [("1", "x y"), ("2", "z z")]), ('a,b\n"1,5",2\n3,4,5\n6,7\n', "utf-8", None),
])
def test_read_any(spark, tmp_path, text, encoding, want):
    (tmp_path / "f.txt").write_bytes(text.encode(encoding))
    got = tables.read_any(spark, str(tmp_path / "f.txt"))
    if want is None:
        # A line too wide keeps the strategy from fitting by its first lines: commas are taken all the same, the line goes.
        assert [tuple(r) for r in got.collect()] == [("1,5", "2"), ("6", "7")]
    else:
        assert got.columns == ["a", "b"] and [tuple(r) for r in got.collect()] == want


def test_portable_xrf(spark):
    columns = ["Instrument Serial Num", "SampleID", "Units", "Zn Concentration", "Zn Error1s", "Zn Compound", "Zn Compound Level", "Cu Concentration", "Cu Error1s", "Cu User Factor Slope", "my note!"]
    rows = [("S1", "a", None, "12.5", "0.4", "ZnO", "1", "<LOD", "4", "1", "x"), ("S1", "b", "PPM ", "<LOD", None, "ZnO", "1", "7", "1", "1", None), ("S1", "c", "ppm", "odd", "1", None, None, None, None, "1", "y")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    assert tables.is_pxrf(columns) and not tables.is_pxrf(["a", "Units"])
    got = tables.pxrf_table(df)
    assert got.columns == ["Instrument_SN", "Sample_ID", "Units", "Zn_ppm", "Zn_err", "Cu_ppm", "Cu_err", "my_note_"]
    assert [r.Zn_ppm for r in got.collect()] == [12.5, 0, None] and [r.Cu_ppm for r in got.collect()] == [pytest.approx(4 / math.sqrt(2)), 7, None]
    assert [tables.pxrf_table(df, b).first().Cu_ppm for b in ("zero", "half", "keep")] == [0, 2, None] and "Zn_err" not in tables.pxrf_table(df, errors=False, custom=False).columns
    with pytest.raises(ValueError):
        tables.pxrf_table(df, "odd")
