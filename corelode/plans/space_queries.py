"""Queries of associations, recalculation, grids, neighbours, breaks and normal scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.operators import association, breaks, grids, multivariate, nearest, normality, recalculation, spatial
from corelode.plans.registry import query, read, rounded

_ELEMENTS = ("Mg", "Sc", "Ni", "Cr", "V", "Fe", "Pb", "Zn", "Ag", "Cu", "Au", "Sn")


def _assays(spark, sf_dir):
    """Element columns that move together by origin: mafic elements with size, ore elements with price."""
    key, size, price = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice")
    made = [((size if k < 6 else price / 20) + (key * (k + 3)) % 17).alias(e) for k, e in enumerate(_ELEMENTS)]
    return read(spark, sf_dir, "part").select("p_partkey", *made)


@query(None)
def association_matches(spark, sf_dir):
    loadings = multivariate.pca_loadings(_assays(spark, sf_dir), list(_ELEMENTS)).select("component", F.col("column").alias("element"), "loading")
    return rounded(association.associate(loadings), 4)


@query(None)
def association_summary(spark, sf_dir):
    loadings = multivariate.pca_loadings(_assays(spark, sf_dir), list(_ELEMENTS)).select("component", F.col("column").alias("element"), "loading")
    return association.association_quality(loadings, association.associate(loadings))


#: Loadings made from brands: one set of twelve for each of them, as if from a component each.
_CASES = f"""SELECT p_brand AS brand, element, loading FROM (SELECT p_brand, round(avg(CASE WHEN p_partkey % 12 = 0 THEN p_size END) / 40 - 0.3, 3) AS shift FROM part GROUP BY 1),
(VALUES {', '.join(f"('{e}', {k})" for k, e in enumerate(_ELEMENTS))}) t(element, k), LATERAL (SELECT round(CASE WHEN k < 6 THEN 0.9 - 0.07 * k ELSE -0.2 - 0.06 * (k - 6) END * (0.6 + shift), 6) AS loading)"""


def _score_sql() -> str:
    """Scores before discrimination, of patterns without rules that both weigh: the tiers written out."""
    tiers = ", ".join(f"('{p.id}', '{t}', '{e}')" for p in association.PATTERNS for t in ("core", "common", "optional", "anti") for e in getattr(p, t))
    patterns = ", ".join(f"('{p.id}', {len(p.optional)}, {p.least_core})" for p in association.PATTERNS)
    return f"""WITH l AS ({_CASES}), e AS (SELECT brand, 'positive' AS side, element, loading AS s FROM l UNION ALL SELECT brand, 'negative', element, -loading FROM l),
a AS (SELECT brand, side, count(*) FILTER (s >= 0.3) AS size, coalesce(avg(s) FILTER (s >= 0.3), 0) AS mean FROM e GROUP BY 1, 2),
t(pattern, tier, element) AS (VALUES {tiers}), p(pattern, optional_size, least) AS (VALUES {patterns}),
c AS (SELECT brand, side, pattern, count(*) FILTER (tier = 'core') AS core, count(*) FILTER (tier = 'core' AND s >= 0.3) AS core_in, count(*) FILTER (tier = 'core' AND s >= 0.2 AND s < 0.3) AS core_near, count(*) FILTER (tier = 'common') AS common,
count(*) FILTER (tier = 'common' AND s >= 0.3) AS common_in, count(*) FILTER (tier = 'optional' AND s >= 0.3) AS optional_in, count(*) FILTER (tier = 'anti' AND s >= 0.3) AS anti_in,
coalesce(max(s) FILTER (tier IN ('core', 'common') AND s >= 0.3) - min(s) FILTER (tier IN ('core', 'common') AND s >= 0.3), 0) AS width FROM e JOIN t USING (element) GROUP BY 1, 2, 3),
x AS (SELECT *, coalesce((core_in + 0.5 * core_near) / nullif(core, 0), 0) AS effective FROM a JOIN c USING (brand, side) JOIN p USING (pattern)),
y AS (SELECT *, greatest(0, least(100, (50 * least(1, effective) + 25 * coalesce(common_in / nullif(common, 0), 0) + 10 * optional_in / optional_size + CASE WHEN mean >= 0.5 THEN 15 WHEN mean >= 0.3 THEN 7.5 ELSE 0 END - 15 * anti_in) * (1 - 0.6 * greatest(0, least(1, (width - 0.3) / 0.3))))) AS confidence FROM x WHERE core = 0 OR effective >= least)
SELECT brand, side AS "end", pattern, round(confidence, 8) AS confidence FROM y WHERE confidence >= 25"""


@query(_score_sql())
def association_scores(spark, sf_dir):
    """One set of loadings for each brand, without discrimination."""
    size = F.round(F.avg(F.when(F.col("p_partkey") % 12 == 0, F.col("p_size"))) / 40 - 0.3, 3)
    shifts = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(size.alias("shift"))
    base = F.explode(F.array(*[F.struct(F.lit(e).alias("element"), F.lit(0.9 - 0.07 * k if k < 6 else -0.2 - 0.06 * (k - 6)).alias("b")) for k, e in enumerate(_ELEMENTS)]))
    loadings = shifts.select("brand", "shift", base.alias("x")).select("brand", F.col("x.element").alias("element"), F.round(F.col("x.b") * (0.6 + F.col("shift")), 6).alias("loading"))
    return rounded(association.associate(loadings, rules=(), most=None, by=["brand"]).select("brand", "end", "pattern", "confidence"), 8)


_ROCK = {"SiO2": "44 + l_linenumber", "TiO2": "l_tax * 10", "Al2O3": "l_quantity / 5", "MgO": "l_quantity / 1.4", "CaO": "l_discount * 100", "Na2O": "l_tax * 20", "MnO": "0.2", "Cr2O3": "0.4"}
_IRON, _SULFUR, _COPPER, _NICKEL, _LOI = "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_suppkey % 14 END", "l_orderkey % 6", "l_partkey % 900", "l_suppkey % 4000", "l_linenumber * 1.5"


def _rocks(spark, sf_dir):
    made = {**_ROCK, "Fe": _IRON, "S": _SULFUR, "Cu": _COPPER, "Ni": _NICKEL, "LOI": _LOI}
    return read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", *[f"cast({x} as double) as {o}" for o, x in made.items()])


_ASSIGNED = recalculation.Assignment({o: o for o in _ROCK}, {"Fe2O3T": "Fe"}, "S", "Cu", "Ni", ("LOI",), ppm=("Cu", "Ni"))
_OWN = [o for o in recalculation.OXIDES if o in _ROCK]
_W = {"S": 32.065, "Fe": 55.845, "Ni": 58.693, "Cu": 63.546, "O": 15.999}
_FEO, _FE2O3 = _W["Fe"] + _W["O"], 2 * _W["Fe"] + 3 * _W["O"]


def _recalculated_sql() -> str:
    solid = " + ".join([*_OWN, "iron", "s", "cu", "ni"])
    oxides = " + ".join(f"a_{o}" for o in _OWN)
    return f"""WITH r AS (SELECT l_returnflag, {', '.join(f'({x})::DOUBLE AS {o}' for o, x in _ROCK.items())}, ({_IRON})::DOUBLE AS fe, coalesce(({_IRON})::DOUBLE, 0) * 0.8998 AS iron, ({_SULFUR})::DOUBLE AS s, ({_COPPER}) / 10000.0 AS cu, ({_NICKEL}) / 10000.0 AS ni, ({_LOI})::DOUBLE AS loi FROM lineitem),
f AS (SELECT *, 100 / ({solid}) AS k, CASE WHEN loi > 9 THEN 'volatile' WHEN fe IS NULL THEN 'incomplete' WHEN {solid} + loi < 85 THEN 'low total' END AS gate FROM r),
a AS (SELECT l_returnflag, gate, {', '.join(f'{o} * k AS a_{o}' for o in _OWN)}, iron * k AS a_iron, s * k AS a_s, cu * k AS a_cu, ni * k AS a_ni FROM f),
b AS (SELECT *, {oxides} AS ox, a_s > 2 AS first, CASE WHEN a_MgO >= 50 THEN 0 WHEN a_MgO <= 25 THEN 0.1 ELSE 0.1 * (1 - (a_MgO - 25) / 25) END AS ratio FROM a),
c AS (SELECT *, greatest(0, a_MgO * 100 / (ox + a_iron) - 10) * 90 * ((ox + a_iron) / 100) * 1e-4 AS given FROM b),
d AS (SELECT *, CASE WHEN first THEN (a_s / {_W['S']} - a_cu / {_W['Cu']} - greatest(0, a_ni - given) / {_W['Ni']}) * {_W['Fe']} ELSE 0.75 * a_s / {_W['S']} * {_W['Fe']} END AS raw_fe, CASE WHEN first THEN greatest(0, a_ni - given) ELSE a_s / {_W['S']} * {_W['Ni']} / 4 END AS nisul FROM c),
e AS (SELECT *, greatest(0, raw_fe) AS fes, a_s + greatest(0, raw_fe) + nisul + a_cu AS mode, CASE WHEN first THEN given ELSE greatest(0, a_ni - nisul) END AS nisil, greatest(0, a_iron - greatest(0, raw_fe) * {_FEO / _W['Fe']!r}) AS feleft FROM d),
g AS (SELECT *, greatest(0, (feleft / {_FEO!r} - 2 * (feleft / {_FEO!r} * ratio / (1 + ratio))) * {_FEO!r}) AS feo, feleft / {_FEO!r} * ratio / (1 + ratio) * {_FE2O3!r} AS fe2o3, CASE WHEN mode > 0 AND a_s > 2 THEN 100 * nisul / mode END AS tenor FROM e),
h AS (SELECT *, 100 / (ox + feo + fe2o3) AS again FROM g),
z AS (SELECT *, coalesce(gate, CASE WHEN a_MgO * again > 52 OR (feo + fe2o3) * again > 30 THEN 'implausible' WHEN mode > 50 THEN 'sulfide' ELSE 'ok' END) AS status FROM h)"""


@query(_recalculated_sql() + """ SELECT l_returnflag, status, count(*)::BIGINT AS n, round(sum(CASE WHEN gate IS NULL THEN a_SiO2 ELSE 0 END), 4) AS silica_anhydrous, round(sum(CASE WHEN status = 'ok' THEN a_MgO * again ELSE 0 END), 4) AS magnesia,
round(sum(CASE WHEN status = 'ok' THEN feo * again ELSE 0 END), 4) AS feo, round(sum(CASE WHEN status = 'ok' THEN fe2o3 * again ELSE 0 END), 4) AS fe2o3, round(sum(CASE WHEN gate IS NULL THEN mode END), 4) AS sulfide, round(sum(CASE WHEN gate IS NULL AND tenor <= 20 THEN tenor END), 4) AS tenor,
round(sum(CASE WHEN gate IS NULL THEN nisil END), 4) AS silicate_nickel FROM z GROUP BY 1, 2""")
def oxide_recalculation(spark, sf_dir):
    made = recalculation.recalculate(_rocks(spark, sf_dir), _ASSIGNED, most_volatile=9.0)
    sums = {"silica_anhydrous": "SiO2_anhyd", "magnesia": "MgO_recalc", "feo": "FeO_recalc", "fe2o3": "Fe2O3_recalc", "sulfide": "sulfide_mode", "tenor": "ni_tenor", "silicate_nickel": "ni_silicate"}
    return rounded(made.groupBy("l_returnflag", F.col("recalc_status").alias("status")).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()]), 4)


@query(_recalculated_sql() + f""", q AS (SELECT {', '.join(f'count(*) FILTER (status = {s!r})::BIGINT AS {s.replace(" ", "_")}' for s in ('ok', 'volatile', 'incomplete', 'low total', 'implausible', 'sulfide'))},
count(*)::BIGINT AS rows, count(*) FILTER (gate IS NULL AND raw_fe < 0)::BIGINT AS negative_iron, count(*) FILTER (gate IS NULL AND tenor > 20)::BIGINT AS high_tenor FROM z) SELECT * FROM q""")
def recalculation_warnings(spark, sf_dir):
    return rounded(recalculation.recalculation_summary(recalculation.recalculate(_rocks(spark, sf_dir), _ASSIGNED, most_volatile=9.0)))


_POINTS = "SELECT p_partkey AS id, (p_partkey % 50)::DOUBLE AS x, p_size::DOUBLE AS y, p_retailprice AS v FROM part WHERE p_partkey % 7 < 3 AND p_size > 10"


def _points(spark, sf_dir):
    some = read(spark, sf_dir, "part").where("p_partkey % 7 < 3 and p_size > 10")
    return some.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_retailprice").alias("v"))


_GRID = f"""p AS ({_POINTS}), b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p), g AS (SELECT c AS col, r AS row, x0 + (x1 - x0) * c / 19 AS nx, y0 + (y1 - y0) * r / 19 AS ny FROM b, range(20) t1(c), range(20) t2(r)),
d AS (SELECT col, row, v, greatest((nx - x) ** 2 + (ny - y) ** 2, 1e-10) AS d2 FROM g, p WHERE (nx - x) ** 2 + (ny - y) ** 2 <= 9), i AS (SELECT col, row, sum(v / power(d2, 0.75)) / sum(1 / power(d2, 0.75)) AS z FROM d GROUP BY 1, 2)"""


@query(f"""WITH {_GRID}, k AS (SELECT c AS dc, r AS dr, exp(-(c * c + r * r) / 8.0) AS w FROM range(-6, 7) t1(c), range(-6, 7) t2(r) WHERE c * c + r * r <= 36)
SELECT (col + dc)::BIGINT AS col, (row + dr)::BIGINT AS row, round(sum(w * z) / sum(w), 4) AS z FROM i, k WHERE col + dc BETWEEN 0 AND 19 AND row + dr BETWEEN 0 AND 19 GROUP BY 1, 2""")
def idw_smoothed(spark, sf_dir):
    grid = spatial.idw_grid(_points(spark, sf_dir), "x", "y", "v", 20, 3.0)
    return rounded(grids.smooth_grid(grid, 20, 20, 2.0), 4)


@query(f"""WITH {_GRID}, n AS (SELECT g.col, g.row, min((nx - x) ** 2 + (ny - y) ** 2) AS d2 FROM g, p GROUP BY 1, 2), m AS (SELECT n.col, n.row, sqrt(d2) AS d, z FROM n JOIN i ON i.col = n.col AND i.row = n.row)
SELECT col::BIGINT AS col, row::BIGINT AS row, round(CASE WHEN d <= 0.9 THEN z WHEN d <= 1.8 THEN z * (1 - (d - 0.9) / 0.9) + (d - 0.9) / 0.9 END, 4) AS z FROM m""")
def idw_faded(spark, sf_dir):
    points = _points(spark, sf_dir)
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    grid = spatial.idw_grid(points, "x", "y", "v", 20, 3.0).join(box)
    nodes = grid.select("col", "row", "z", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("col") / 19).alias("nx"), (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("row") / 19).alias("ny"))
    return rounded(grids.faded(nodes, points, "x", "y", 0.6).select("col", "row", "z"), 4)


@query("""WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*) AS n, min(x) - 0.02 * (max(x) - min(x)) AS x0, 1.04 * (max(x) - min(x)) AS wx, min(y) - 0.02 * (max(y) - min(y)) AS y0, 1.04 * (max(y) - min(y)) AS wy, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM p),
h AS (SELECT *, power(n, -1 / 3.0) * vx / (wx / 39) ** 2 AS xx, power(n, -1 / 3.0) * cxy / ((wx / 39) * (wy / 39)) AS xy, power(n, -1 / 3.0) * vy / (wy / 39) ** 2 AS yy FROM s),
r AS (SELECT *, xx * yy - xy * xy AS det, least(ceil(3 * sqrt(greatest(xx, 1))), 20)::BIGINT AS rc, least(ceil(3 * sqrt(greatest(yy, 1))), 20)::BIGINT AS rr FROM h),
k AS (SELECT c, d, exp(-0.5 * m) / sum(exp(-0.5 * m)) OVER () AS w FROM (SELECT c, d, (yy * c * c - 2 * xy * c * d + xx * d * d) / det AS m, rc, rr FROM r, range(-20, 21) t1(c), range(-20, 21) t2(d)) WHERE abs(c) <= rc AND abs(d) <= rr AND m <= 9),
g AS (SELECT floor((x - x0) / (wx / 39) + 0.5)::BIGINT AS col, floor((y - y0) / (wy / 39) + 0.5)::BIGINT AS row, ln(1 + count(*)) AS z FROM p, s GROUP BY 1, 2),
o AS (SELECT col + c AS col, row + d AS row, sum(w * z) AS v FROM g, k WHERE col + c BETWEEN 0 AND 39 AND row + d BETWEEN 0 AND 39 GROUP BY 1, 2)
SELECT col, row, round(v / max(v) OVER (), 5) AS density FROM o QUALIFY v / max(v) OVER () >= 0.01""")
def kernel_density(spark, sf_dir):
    return rounded(grids.kernel_density(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 40), 5)


_PAIRS = "a AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 400.0 AS y FROM supplier), c AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 400.0 + c_custkey % 7 AS y FROM customer)"


def _places(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 400.0).alias("y"))
    return a, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 400.0 + F.col("c_custkey") % 7).alias("y"))


@query(f"""WITH {_PAIRS}, d AS (SELECT a.id AS s, c.id AS n, (a.x - c.x) ** 2 + (a.y - c.y) ** 2 AS d2 FROM a, c) SELECT s, arg_min(n, (d2, n)) AS nearest_c, round(sqrt(min(d2)), 5) AS distance FROM d GROUP BY 1""")
def nearest_neighbours(spark, sf_dir):
    left, right = _places(spark, sf_dir)
    return rounded(nearest.nearest(left, right, "s", "c", "x", "y"), 5)


@query(f"""WITH {_PAIRS}, d AS (SELECT a.id AS s, c.id AS n, (a.x - c.x) ** 2 + (a.y - c.y) ** 2 AS d2 FROM a, c WHERE (a.x - c.x) ** 2 + (a.y - c.y) ** 2 <= 250000) SELECT s, arg_min(n, (d2, n)) AS nearest_c, round(sqrt(min(d2)), 5) AS distance FROM d GROUP BY 1""")
def nearest_within(spark, sf_dir):
    left, right = _places(spark, sf_dir)
    return rounded(nearest.nearest(left, right, "s", "c", "x", "y", radius=500.0), 5)


def _geodetic_sql() -> str:
    n = 1 / (2 * 298.257223563 - 1)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    sh, ch = (lambda k: f"((exp({k} * e) - exp(-{k} * e)) / 2)"), (lambda k: f"((exp({k} * e) + exp(-{k} * e)) / 2)")
    north = " ".join(f"- {c!r} * sin({2 * k} * x) * {ch(2 * k)}" for k, c in enumerate(beta, 1))
    east = " ".join(f"- {c!r} * cos({2 * k} * x) * {sh(2 * k)}" for k, c in enumerate(beta, 1))
    lat = " ".join(f"+ {c!r} * sin({2 * k} * c)" for k, c in enumerate(delta, 1))
    return f"""WITH p AS (SELECT c_custkey, 300000 + c_acctbal * 20 AS east, 6000000 + c_nationkey * 10000.0 AS north FROM customer), a AS (SELECT c_custkey, (north - 10000000) / {scale!r} AS x, (east - 500000) / {scale!r} AS e FROM p),
b AS (SELECT c_custkey, x {north} AS xn, e {east} AS en FROM a), c AS (SELECT c_custkey, asin(sin(xn) / ((exp(en) + exp(-en)) / 2)) AS c, atan2((exp(en) - exp(-en)) / 2, cos(xn)) AS l FROM b)
SELECT c_custkey, round(degrees(c {lat}), 9) AS latitude, round(117 + degrees(l), 9) AS longitude FROM c"""


@query(_geodetic_sql())
def projected_to_wgs84(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", (300000 + F.col("c_acctbal") * 20).alias("east"), (6000000 + F.col("c_nationkey") * 10000.0).alias("north"))
    return rounded(nearest.to_wgs84(rows, "east", "north", 32750).select("c_custkey", "latitude", "longitude"), 9)


@query("""WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders), b AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi FROM s)
SELECT 'equal' AS kind, k::BIGINT AS k, round(CASE WHEN k = 5 THEN hi ELSE lo + (hi - lo) / 5 * k END, 4) AS value FROM b, range(6) t(k) UNION ALL SELECT 'quantile', k, round(v, 4) FROM b, range(6) t(k), s WHERE i = CASE WHEN k = 5 THEN n - 1 ELSE n * k // 5 END""")
def class_breaks(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    rows = [(kind, k, float(v)) for kind, f in (("equal", breaks.equal_breaks), ("quantile", breaks.quantile_breaks)) for k, v in enumerate(f(orders, "o_totalprice", 5))]
    return rounded(spark.createDataFrame(rows, "kind string, k int, value double"), 4)


#: All ways to cut the fifty quantities into four classes.
@query("""WITH q AS MATERIALIZED (SELECT l_quantity AS v, count(*) AS m FROM lineitem GROUP BY 1), u AS MATERIALIZED (SELECT v, sum(m) OVER w AS n, sum(m * v) OVER w AS s, sum(m * v * v) OVER w AS q, row_number() OVER w AS i FROM q WINDOW w AS (ORDER BY v)),
t AS (SELECT max(i) AS top FROM u), z AS (SELECT 0 AS i, 0 AS n, 0 AS s, 0 AS q UNION ALL SELECT i, n, s, q FROM u),
k AS MATERIALIZED (SELECT a.i AS lo, b.i AS hi, b.q - a.q - (b.s - a.s) ** 2 / (b.n - a.n) AS ss FROM z a JOIN z b ON a.i < b.i), best AS (SELECT arg_min((a.hi, b.hi, c.hi), a.ss + b.ss + c.ss + d.ss) AS cut FROM t, k a JOIN k b ON b.lo = a.hi JOIN k c ON c.lo = b.hi JOIN k d ON d.lo = c.hi WHERE a.lo = 0 AND d.hi = top)
SELECT x.k::BIGINT AS k, x.v AS value FROM (SELECT 0 AS k, min(v) AS v FROM q UNION ALL SELECT 4, max(v) FROM q UNION ALL SELECT 1, v FROM u, best WHERE i = cut[1] + 1 UNION ALL SELECT 2, v FROM u, best WHERE i = cut[2] + 1 UNION ALL SELECT 3, v FROM u, best WHERE i = cut[3] + 1) x""")
def natural_breaks(spark, sf_dir):
    found = breaks.jenks_breaks(read(spark, sf_dir, "lineitem"), "l_quantity", 4)
    return rounded(spark.createDataFrame([(k, v) for k, v in enumerate(found)], "k int, value double"))


_Z = "t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))"


@query(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, count(*) OVER () AS n FROM orders), p AS (SELECT *, (rank - 0.5) / n AS p FROM r), q AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p)
SELECT o_orderkey, rank::BIGINT AS rank, round(CASE WHEN p < 0.5 THEN -({_Z}) ELSE {_Z} END, 6) AS n_score, round(100 * p, 6) AS probability, round(100.0 * rank / n, 6) AS cumulative FROM q""")
def probability_plot(spark, sf_dir):
    found = normality.probability_plot(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])
    return rounded(found.drop("o_totalprice"))


_F = "CASE WHEN z >= 0 THEN 1 - 0.3989422804014327 * exp(-z * z / 2) * y ELSE 0.3989422804014327 * exp(-z * z / 2) * y END"


@query(f"""WITH s AS (SELECT count(*) AS n, avg(p_size) AS m, stddev_samp(p_size) AS sd FROM part), r AS (SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS r, (p_size - m) / sd AS z, n FROM part, s), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM r),
y AS (SELECT *, t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS y FROM t), f AS (SELECT r, n, greatest(1e-15, least(1 - 1e-15, {_F})) AS f FROM y),
a AS (SELECT f.n, (-f.n - sum((2 * f.r - 1) * (ln(f.f) + ln(1 - g.f))) / f.n) * (1 + 0.75 / f.n + 2.25 / (f.n * f.n)) AS a FROM f JOIN f g ON g.r = f.n + 1 - f.r GROUP BY f.n)
SELECT n::BIGINT AS n, round(a, 5) AS statistic, round(greatest(0, least(1, CASE WHEN a < 0.2 THEN 1 - exp(-13.436 + 101.14 * a - 223.73 * a * a) WHEN a < 0.34 THEN 1 - exp(-8.318 + 42.796 * a - 59.938 * a * a) WHEN a < 0.6 THEN exp(0.9177 - 4.279 * a - 1.38 * a * a) ELSE exp(1.2937 - 5.709 * a + 0.0186 * a * a) END)), 5) AS p FROM a""")
def anderson_darling(spark, sf_dir):
    return rounded(normality.anderson_darling(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", ["p_partkey"]), 5)


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (ORDER BY l_quantity) AS lo, count(*) OVER (PARTITION BY l_quantity) AS m, count(*) OVER () AS n FROM lineitem), p AS (SELECT l_returnflag, (lo + (m - 1) / 2.0 - 1) / (n - 1) AS p FROM r)
SELECT l_returnflag, round(avg(p), 6) AS percentile, round(avg(0.1 + 0.9 * p ** 2), 6) AS opacity FROM p GROUP BY 1""")
def rank_emphasis(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    shown = normality.percentile_rank(normality.emphasis(lines, "l_quantity", 0.1, 2.0), "l_quantity")
    return rounded(shown.groupBy("l_returnflag").agg(F.avg("percentile").alias("percentile"), F.avg("opacity").alias("opacity")))


_LIMITS = {"l_discount": 0.01, "l_tax": 0.001}


@query("WITH " + ", ".join(f"{c} AS (SELECT '{c}' AS element, count(*) FILTER ({c} <= {_LIMITS.get(c, f'(SELECT min({c}) FROM lineitem)')}) AS below, count({c}) AS n FROM lineitem)" for c in ("l_discount", "l_tax", "l_quantity")) + """,
a AS (SELECT * FROM l_discount UNION ALL SELECT * FROM l_tax UNION ALL SELECT * FROM l_quantity) SELECT element, below::BIGINT AS below, n::BIGINT AS n, round(100.0 * below / n, 6) AS percent_below, below / n::DOUBLE < 0.15865525393145707 AS acceptable FROM a""")
def element_quality(spark, sf_dir):
    """The normal score itself is held against the standard library in the tests."""
    return rounded(normality.element_quality(read(spark, sf_dir, "lineitem"), ["l_discount", "l_tax", "l_quantity"], _LIMITS).drop("n_score"))
