"""Associations, recalculation, grids, neighbours, breaks and normal scores beside plain versions and odd rows."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelode.operators import association, breaks, grids, nearest, normality, ordering, recalculation
from corelode.plans import catalogue


def _loadings(spark, *sets):
    return spark.createDataFrame([(k, e, float(v)) for k, s in enumerate(sets) for e, v in s.items()], "component int, element string, loading double")


def _falling(elements, top=0.6):
    """Loadings that fall by 0.05; at least just beyond the threshold, so that all of them count."""
    return {e: max(0.31, top - 0.05 * k) for k, e in enumerate(elements)}


def _scores(spark, elements, top=0.6, **how):
    found = association.associate(_loadings(spark, _falling(elements, top)), least=how.pop("least", 0.0), most=None, **how)
    return {r.pattern: r for r in found.where("end = 'positive'").collect()}


def test_ends(spark):
    told = association.ends(_loadings(spark, {"Pb": 0.8, "Zn": 0.6, "Cu": 0.4, "Fe": 0.25, "Al": -0.3, "Ti": -0.5}), 0.3, ["component"], association.Scoring())
    held = {(r.end, r.element) for r in told.where("held").collect()}
    assert held == {("positive", "Pb"), ("positive", "Zn"), ("positive", "Cu"), ("negative", "Al"), ("negative", "Ti")}
    assert [r.element for r in told.where("near").collect()] == ["Fe"]


def test_pattern_scores(spark):
    vhms = _scores(spark, ["Sn", "Bi", "In", "Au", "Ag", "As"])["MIN_VHMS"]
    assert vhms.confidence > 50 and vhms.core_score == 100 and not vhms.lithophile_interference
    # One of five core elements that were measured is below the least share.
    short = association.associate(_loadings(spark, {"Sn": 0.6, "Bi": 0.0, "In": 0.0, "Au": 0.0, "Ag": 0.0}), least=0.0, most=None).where("pattern = 'MIN_VHMS'").collect()
    assert {r.confidence for r in short} == {0.0}
    clean, dirty = (_scores(spark, ["Mg", "Ti", "Sc", "Ni", "Cr", "V", *more])["LITH_MAFIC"].confidence for more in ([], ["Pb", "U"]))
    assert dirty < clean
    assert _scores(spark, ["Sn", "Bi", "Au", "Ag", "Al", "Zr"])["MIN_VHMS"].lithophile_interference
    assert _scores(spark, ["Pb", "Zn", "Cd", "Ag", "As", "Sb", "Tl"])["MIN_SHMS"].confidence > 40
    assert _scores(spark, ["Cu", "Au", "Mo", "Bi", "Te", "Ag"], 0.65)["MIN_PORPHYRY_CU"].confidence > 30
    both = _scores(spark, ["Pb", "Zn", "Cd", "Ag", "Tl", "Hg"])
    assert both["MIN_SHMS"].confidence >= both["MIN_MVT"].confidence
    best = min(_scores(spark, ["Sn", "Bi", "In", "Au", "Ag", "As", "Sb", "Pb", "Cu", "Zn"], 0.65).values(), key=lambda r: r["rank"])
    assert best.pattern in ("MIN_VHMS", "MIN_SHMS")
    best = min(_scores(spark, ["Mg", "Sc", "Ni", "Cr", "V", "Co", "Fe", "Ti"], 0.7).values(), key=lambda r: r["rank"])
    assert best.category == "lithological" and best["rank"] == 1


def test_score_by_hand(spark):
    loadings = {"Sn": 0.9, "Bi": 0.5, "In": 0.25, "Au": 0.0, "Ag": 0.0, "As": 0.8, "Sb": 0.1, "Mo": 0.4}
    got = association.associate(_loadings(spark, loadings), rules=(), least=0.0, most=None).where("pattern = 'MIN_VHMS' and end = 'positive'").first()
    effective, mean = 2 / 5 + 0.5 / 5, (0.9 + 0.5 + 0.8 + 0.4) / 4
    raw = 50 * effective + 25 * (1 / 2) + 10 * (1 / 3) + (15 if mean >= 0.5 else 7.5)
    assert got.confidence == pytest.approx(raw * (1 - 0.6 * min(1, (0.9 - 0.5 - 0.3) / 0.3))) and got.elements == "Sn-As-Bi-Mo"
    assert got.completeness == pytest.approx(100 * 4 / (5 + 2 + 3)) and got.purity == 100 and got.level == "low"


def test_discrimination(spark):
    told = {n: {r.pattern: r.confidence for r in association.associate(_loadings(spark, _falling(["Pb", "Zn", "Cd", "Ag", "Sn", "Bi", "In", "Au"])), rules=r, most=None).where("end = 'positive'").collect()} for n, r in (("without", ()), ("with", association.RULES))}
    gained = told["with"]["MIN_VHMS"] - told["without"]["MIN_VHMS"]
    # Sn, Bi and In are core of the first alone: five points for each unit of loading.
    assert gained == pytest.approx(5 * (0.4 + 0.35 + 0.31)) and told["with"]["MIN_SHMS"] == told["without"]["MIN_SHMS"]


def test_association_of_components(spark):
    one = {"Pb": 0.8, "Zn": 0.7, "Ag": 0.6, "Cu": 0.3, "Al": -0.5, "Ti": -0.6, "Zr": -0.7, "Fe": 0.2}
    two = dict(zip(one, (-0.3, -0.2, -0.1, 0.7, 0.3, 0.4, 0.2, 0.8), strict=True))
    loadings = _loadings(spark, one, two)
    matches = association.associate(loadings)
    quality = {r.component: r for r in association.association_quality(loadings, matches).collect()}
    assert set(quality) == {0, 1} and quality[0].strong and quality[0].positive and quality[0].mineralised and quality[0].independent
    assert association.associate(loadings.limit(0)).count() == 0
    empty = association.associate(_loadings(spark, {"Fe": 0.2, "Al": 0.1}))
    assert empty.count() == 0 and association.association_quality(_loadings(spark, {"Fe": 0.2}), empty).first().positive is None


def _plain_recalculated(row, method="auto", limit=2.0, sm=1.0, fn=3.0):
    own = {o: row.get(o) or 0.0 for o in recalculation.OXIDES}
    s, cu, ni, loi = (row.get(k) or 0.0 for k in ("S", "Cu", "Ni", "LOI"))
    if row.get("SiO2") is None or row.get("Fe") is None:
        return "incomplete", None
    iron = row["Fe"]
    total = sum(own.values()) + iron + s + cu + ni
    if total + loi < 85:
        return "low total", None
    k = 100 / total
    own, iron, s, cu, ni = {o: v * k for o, v in own.items()}, iron * k, s * k, cu * k, ni * k
    silicate = sum(own.values()) + iron
    if (s > limit) if method == "auto" else method == "method1":
        nisil = max(0, own["MgO"] * 100 / silicate - 10) * 90 * silicate / 100 / 10_000
        nisul = max(0, ni - nisil)
        fe = (s / 32.065 - cu / 63.546 / sm - nisul / 58.693) * 55.845
    else:
        fe, nisul = fn / (1 + fn) * s / 32.065 * 55.845 / sm, s / 32.065 * 58.693 / (1 + fn) / sm
    fe = max(0, fe)
    left = max(0, iron - fe * 71.844 / 55.845)
    ratio = 0 if own["MgO"] >= 50 else 0.1 if own["MgO"] <= 25 else 0.1 * (1 - (own["MgO"] - 25) / 25)
    ferric = left / 71.844 * ratio / (1 + ratio)
    feo, fe2o3 = max(0, (left / 71.844 - 2 * ferric) * 71.844), ferric * 159.687
    again = 100 / (sum(own.values()) + feo + fe2o3)
    mode = s + fe + nisul + cu
    status = "implausible" if own["MgO"] * again > 52 or (feo + fe2o3) * again > 30 else "sulfide" if mode > 50 else "ok"
    return status, (own["SiO2"] * again, feo * again, fe2o3 * again, mode)


@pytest.mark.parametrize("method", ["auto", "method1", "method2"])
def test_recalculation(spark, method):
    draw = np.random.default_rng(2)
    names = ("SiO2", "Al2O3", "MgO", "CaO", "Fe", "S", "Cu", "Ni", "LOI")
    rows = [dict(zip(names, map(float, draw.uniform((20, 0, 0, 0, 0, 0, 0, 0, 0), (60, 20, 60, 10, 30, 20, 2, 3, 8))), strict=True)) for _ in range(60)]
    rows += [{n: None for n in names}, dict(zip(names, (50.0, None, 30.0, None, 12.0, None, None, None, None), strict=True)), dict(zip(names, (50.0, 10.0, 30.0, 2.0, None, 1.0, 0.0, 0.0, 1.0), strict=True)), dict(zip(names, (1.0, 0.0, 0.0, 0.0, 1.0, 90.0, 1.0, 1.0, 0.0), strict=True))]
    df = spark.createDataFrame([(k, *(r[n] for n in names)) for k, r in enumerate(rows)], "id int, " + ", ".join(f"{n} double" for n in names))
    columns = recalculation.Assignment({o: o for o in names[:4]}, {"FeOT": "Fe"}, "S", "Cu", "Ni", ("LOI",))
    got = {r.id: r for r in recalculation.recalculate(df, columns, method=method).collect()}
    for k, row in enumerate(rows):
        status, values = _plain_recalculated(row, method)
        assert got[k].recalc_status == status
        if values and status == "ok":
            assert np.allclose((got[k].SiO2_recalc, got[k].FeO_recalc, got[k].Fe2O3_recalc, got[k].sulfide_mode), values)
            assert sum(got[k][f"{o}_recalc"] for o in (*recalculation.OXIDES, "FeO", "Fe2O3")) == pytest.approx(100)
        elif values is None:
            assert got[k].SiO2_anhyd == 0 and got[k].sulfide_mode is None
    assert {"incomplete", "ok"} < {r.recalc_status for r in got.values()} and not [c for c in df.columns if c not in got[0].asDict()]


def test_recalculation_without_sulfur(spark):
    df = spark.createDataFrame([(50.0, 30.0, 8.0, 2.0, "x"), (50.0, 30.0, 8.0, None, "y")], "SiO2 double, MgO double, FeO double, Fe2O3 double, note string")
    made = recalculation.recalculate(df, recalculation.Assignment({"SiO2": "SiO2", "MgO": "MgO"}, {"FeO": "FeO", "Fe2O3": "Fe2O3"}))
    a, b = made.orderBy("note").collect()
    assert a.recalc_status == "ok" and b.recalc_status == "incomplete" and a.sulfide_mode is None and a.SiO2_recalc + a.MgO_recalc + a.FeO_recalc + a.Fe2O3_recalc == pytest.approx(100)
    assert recalculation.recalculation_summary(made).first().asDict()["incomplete"] == 1
    assert recalculation.recalculation_clr(made).first()["clr_SiO2_recalc"] is None
    full = made.withColumns({f"{o}_recalc": F.lit(1.0 + k) for k, o in enumerate((*recalculation.OXIDES, "FeO", "Fe2O3"))})
    row = recalculation.recalculation_clr(full).first()
    assert sum(row[f"clr_{o}_recalc"] for o in (*recalculation.OXIDES, "FeO", "Fe2O3")) == pytest.approx(0) and "note" in row.asDict()


def test_smoothing_and_fading(spark):
    draw = np.random.default_rng(3)
    z = draw.normal(size=(9, 12))
    z[draw.random(z.shape) < 0.3] = np.nan
    grid = spark.createDataFrame([(c, r, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(9) for c in range(12)], "col long, row long, z double")
    got = {(r.col, r.row): r.z for r in grids.smooth_grid(grid, 12, 9, 1.2).collect()}
    for r, c in itertools.product(range(9), range(12)):
        cells = [(math.exp(-((r - i) ** 2 + (c - j) ** 2) / 2.88), z[i, j]) for i in range(9) for j in range(12) if (r - i) ** 2 + (c - j) ** 2 <= 12.96 and not np.isnan(z[i, j])]
        assert got[c, r] == pytest.approx(sum(w * v for w, v in cells) / sum(w for w, _ in cells))
    assert grids.smooth_grid(grid, 12, 9, 0.0).count() == np.isfinite(z).sum() and grids.smooth_grid(grid.limit(0), 3, 3).count() == 0
    nodes = spark.createDataFrame([(0.0, 0.0, 5.0), (2.0, 0.0, 5.0), (9.0, 0.0, 5.0)], "nx double, ny double, z double")
    points = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (None, 1.0)], "x double, y double")
    assert [r.z for r in grids.faded(nodes, points, "x", "y", 1.0).orderBy("nx").collect()] == [5.0, pytest.approx(5 * (2 / 3) + 1 / 3), None]


def test_kernel_density_of_odd_points(spark):
    line = spark.createDataFrame([(float(k), float(k)) for k in range(30)] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    got = grids.kernel_density(line, "x", "y", 20).collect()
    assert max(r.density for r in got) == 1 and all(abs(r.col - r.row) < 12 for r in got)
    assert grids.kernel_density(line.limit(5), "x", "y").count() == 0
    assert grids.kernel_density(line.select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), "x", "y", 20).count() > 0


def _plain_nearest(left, right, same=False, radius=None):
    out = {}
    for i, x, y in left:
        told = [((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in right if not (same and i == j)]
        if told and (radius is None or min(told)[0] <= radius**2):
            out[i] = (min(told)[1], math.sqrt(min(told)[0]))
    return out


@pytest.mark.parametrize("same", [False, True])
def test_nearest(spark, same):
    draw = np.random.default_rng(4)
    at = np.concatenate([draw.normal(0, 0.01, (60, 2)), draw.normal(50, 5, (40, 2)), [[500, 500], [0, 0], [0, 0], [0, 0]], np.round(draw.uniform(0, 6, (40, 2)))])
    right = [(k, float(x), float(y)) for k, (x, y) in enumerate(at)]
    left = right if same else [(k, float(x), float(y)) for k, (x, y) in enumerate(draw.uniform(-20, 80, (50, 2)))]
    told = lambda rows, i: spark.createDataFrame([*rows, (None, 1.0, 1.0), (999, None, 1.0)], f"{i} int, x double, y double")
    for radius in (None, 3.0):
        got = nearest.nearest(told(left, "i"), told(right, "j"), "i", "j", "x", "y", radius, same)
        got = {r.i: (r.nearest_j, r.distance) for r in got.collect()}
        want = _plain_nearest(left, right, same, radius)
        assert set(got) == set(want) and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_nearest_of_few(spark):
    none = spark.createDataFrame([], "i int, x double, y double")
    one = spark.createDataFrame([(1, 2.0, 3.0)], "i int, x double, y double")
    assert nearest.nearest(none, none, "i", "i", "x", "y").count() == 0 and nearest.nearest(one, none, "i", "i", "x", "y").count() == 0
    assert nearest.nearest(one, one, "i", "i", "x", "y", same=True).count() == 0 and nearest.nearest(one, one, "i", "i", "x", "y").first().distance == 0


def test_wgs84(spark):
    df = spark.createDataFrame([(500_000.0, 10_000_000.0), (334_368.6336, 6_250_948.3454), (None, 1.0)], "e double, n double")
    equator, sydney, none = nearest.to_wgs84(df, "e", "n", 32756).collect()
    assert (equator.latitude, equator.longitude) == (pytest.approx(0, abs=1e-9), pytest.approx(153, abs=1e-9)) and none.latitude is None
    assert abs(sydney.latitude + 33.8688) < 1e-5 and abs(sydney.longitude - 151.2093) < 1e-5
    gda = nearest.to_wgs84(df, "e", "n", 28356).collect()[1]
    assert abs(gda.latitude - sydney.latitude) < 1e-6
    # On the central meridian the northing is the scaled length of the meridian.
    f = 1 / 298.257223563
    e2, steps = f * (2 - f), np.linspace(0, math.radians(45), 20_001)
    arc = np.trapezoid(6378137 * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5, steps)
    north = spark.createDataFrame([(500_000.0, float(0.9996 * arc))], "e double, n double")
    assert nearest.to_wgs84(north, "e", "n", 32631).first().latitude == pytest.approx(45, abs=1e-8)
    assert nearest.to_wgs84(north, "e", "n", 4326).first().longitude == 500_000
    with pytest.raises(ValueError):
        nearest.to_wgs84(df, "e", "n", 3857)


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_natural_breaks(spark, classes):
    draw = np.random.default_rng(classes)
    v = np.round(np.concatenate([draw.normal(m, 1, 12) for m in (0, 8, 20)]), 1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = breaks.jenks_breaks(df, "v", classes)
    s = np.sort(v)
    spread = lambda x: ((x - x.mean()) ** 2).sum()
    best = min(sum(spread(p) for p in np.split(s, cuts)) for cuts in itertools.combinations(range(1, len(s)), classes - 1))
    at = [int(np.searchsorted(s, b)) for b in got[1:-1]]
    assert sum(spread(p) for p in np.split(s, at)) == pytest.approx(best) and (got[0], got[-1]) == (s[0], s[-1])


def test_breaks(spark, monkeypatch):
    df = spark.createDataFrame([(float(k),) for k in (1, 1, 2, 5, 9, 10, 11)], "v double")
    assert breaks.equal_breaks(df, "v", 2) == [1, 6, 11] and breaks.quantile_breaks(df, "v", 3) == [1, 2, 9, 11] and breaks.jenks_breaks(df, "v", 9) == [1, 2, 5, 9, 10, 11]
    assert breaks.jenks_breaks(df.limit(0), "v", 3) == breaks.equal_breaks(df.limit(0), "v", 3) == breaks.quantile_breaks(df.limit(0), "v", 3) == []
    assert [r[0] for r in df.select(breaks.class_index(F.col("v"), [1.0, 5.0, 11.0])).collect()] == [0, 0, 0, 1, 1, 1, 1] and breaks.class_labels([1.0, 5.0, 11.0]) == ["1.00 - <5.00", "5.00 - 11.00"]
    many = spark.createDataFrame([(float(k if k < 60 else k + 500),) for k in range(100)], "v double")
    monkeypatch.setattr(breaks, "JENKS_VALUES", 40)
    assert 59 < breaks.jenks_breaks(many, "v", 2)[1] <= 570


def test_normal_scores(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PART_ROWS", 50)
    v = np.random.default_rng(5).normal(size=200)
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)] + [(900, None), (901, float("nan"))], "k int, v double")
    got = normality.probability_plot(df, "v", ["k"]).toPandas().sort_values("v")
    p = (np.arange(200) + 0.5) / 200
    assert (got["rank"].to_numpy() == np.arange(1, 201)).all() and np.allclose(got.n_score, [NormalDist().inv_cdf(x) for x in p], atol=1e-3) and np.allclose(got.probability, 100 * p)
    z = np.sort((v - v.mean()) / v.std(ddof=1))
    cdf = np.array([NormalDist().cdf(x) for x in z])
    a = -200 - sum((2 * i + 1) * (math.log(cdf[i]) + math.log(1 - cdf[199 - i])) for i in range(200)) / 200
    told = normality.anderson_darling(df, "v", ["k"]).first()
    assert told.statistic == pytest.approx(a * (1 + 0.75 / 200 + 2.25 / 40_000), abs=1e-4) and told.p > 0.05
    skewed = df.withColumn("v", F.exp(3 * F.col("v")))
    assert normality.anderson_darling(skewed, "v", ["k"]).first().p < 1e-6
    assert normality.anderson_darling(df.limit(5), "v", ["k"]).first().p is None and normality.anderson_darling(df.withColumn("v", F.lit(1.0)), "v", ["k"]).first().p is None
    ranks = normality.percentile_rank(df, "v").toPandas()
    assert np.allclose(ranks.percentile[ranks.k < 900], ranks.v[ranks.k < 900].rank().sub(1) / 199) and ranks.percentile[ranks.k >= 900].isna().all()
    assert normality.emphasis(df, "v").where("k >= 900").select("opacity").distinct().first()[0] == 0.1


def test_element_quality(spark):
    df = spark.createDataFrame([(float(k), 1.0, None) for k in range(100)], "a double, b double, c double")
    got = {r.element: r for r in normality.element_quality(df, ["a", "b", "c"], {"a": 9.0}).collect()}
    assert got["a"].below == 10 and got["a"].n_score == pytest.approx(NormalDist().inv_cdf(0.1)) and got["a"].acceptable
    assert got["b"].n_score == 4 and not got["b"].acceptable and got["c"].percent_below == 100 and not got["c"].acceptable


@pytest.mark.parametrize("name", ["association_matches", "association_scores", "oxide_recalculation", "idw_smoothed", "idw_faded", "kernel_density", "nearest_neighbours", "nearest_within", "natural_breaks"])
def test_queries_have_rows(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 2
