"""Queries of ratios, rules, box statistics, zero modes, log-ratio covariances, adjusted residuals, grades and ternary places."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.operators import checks, compose, qaqc, robust, spatial
from corelode.plans.quality_queries import samples
from corelode.plans.registry import ENTRIES, query, read, rounded

PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""SELECT l_returnflag, count(l_tax / nullif(l_discount, 0))::BIGINT AS ratios, round(avg(l_tax / nullif(l_discount, 0)), 6) AS mean_ratio, round(sum(l_tax + l_discount), 4) AS total, round(avg(CASE WHEN l_discount > 0 THEN ln(l_discount) END), 6) AS mean_log FROM lineitem GROUP BY 1""")
def column_arithmetic(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    made = lines.select("l_returnflag", checks.ratio("l_tax", "l_discount").alias("r"), checks.total(["l_tax", "l_discount"]).alias("t"), checks.transformed("l_discount", lambda v: F.when(v > 0, F.ln(v))).alias("g"))
    return rounded(made.groupBy("l_returnflag").agg(F.count("r").alias("ratios"), F.avg("r").alias("mean_ratio"), F.round(F.sum("t"), 4).alias("total"), F.avg("g").alias("mean_log")))


_RULES = [
    checks.Rule("quantity", "l_quantity", "range", low=2, high=45), checks.Rule("tax", "l_tax", "positive", "warning"), checks.Rule("discount", "l_discount", "non-negative"),
    checks.Rule("shares", "l_tax", "sum", low=0.02, high=0.15, columns=("l_tax", "l_discount")),
]


@query("""SELECT 'quantity' AS rule, 'error' AS severity, count(*) FILTER (l_quantity < 2 OR l_quantity > 45)::BIGINT AS broken, count(*) FILTER (l_quantity < 2 OR l_quantity > 45) = 0 AS valid FROM lineitem
UNION ALL SELECT 'tax', 'warning', count(*) FILTER (l_tax <= 0), true FROM lineitem UNION ALL SELECT 'discount', 'error', count(*) FILTER (l_discount < 0), count(*) FILTER (l_discount < 0) = 0 FROM lineitem
UNION ALL SELECT 'shares', 'error', count(*) FILTER (l_tax + l_discount < 0.02 OR l_tax + l_discount > 0.15), count(*) FILTER (l_tax + l_discount < 0.02 OR l_tax + l_discount > 0.15) = 0 FROM lineitem""")
def validation_report(spark, sf_dir):
    return rounded(checks.rule_report(read(spark, sf_dir, "lineitem"), _RULES))


@query("""SELECT rule, severity, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT 'quantity' AS rule, 'error' AS severity, l_quantity AS value FROM lineitem WHERE l_quantity < 2 OR l_quantity > 45 UNION ALL SELECT 'tax', 'warning', l_tax FROM lineitem WHERE l_tax <= 0
UNION ALL SELECT 'shares', 'error', l_tax FROM lineitem WHERE l_tax + l_discount < 0.02 OR l_tax + l_discount > 0.15) GROUP BY 1, 2""")
def validation_violations(spark, sf_dir):
    found = checks.violations(read(spark, sf_dir, "lineitem"), _RULES, ["l_orderkey", "l_linenumber"])
    return rounded(found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("""WITH s AS (SELECT p_size + p_retailprice / 40 + 12 AS s FROM part) SELECT CASE WHEN s < 95 THEN 'below' WHEN s > 105 THEN 'above' ELSE 'ok' END AS major_status, count(*)::BIGINT AS n, round(avg(s), 6) AS mean_sum FROM s GROUP BY 1""")
def major_oxide_sums(spark, sf_dir):
    rocks = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("sio2"), (F.col("p_retailprice") / 40).alias("Al2O3_pct"), F.lit(12).alias("MgO wt%"))
    return rounded(checks.major_sum(rocks).groupBy("major_status").agg(F.count("*").alias("n"), F.avg("major_sum").alias("mean_sum")))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, CASE WHEN max({c}) <= 100 AND avg({c}) <= 50 THEN 'wt%' WHEN max({c}) <= 1e5 AND avg({c}) <= 1e4 THEN 'ppm' WHEN max({c}) > 1e5 THEN 'ppb' ELSE 'ppm' END AS unit FROM lineitem""" for c in PARTS))
def unit_guesses(spark, sf_dir):
    return rounded(checks.unit_guess(read(spark, sf_dir, "lineitem"), PARTS))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)),
q AS (SELECT l_returnflag, any_value(n) AS n, max(v) FILTER (i = floor(n * 0.25)) AS q1, max(v) FILTER (i = floor(n * 0.5)) AS m, max(v) FILTER (i = floor(n * 0.75)) AS q3 FROM r GROUP BY 1)
SELECT l_returnflag, any_value(q.n)::BIGINT AS n, round(min(v), 4) AS low, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, round(max(v), 4) AS high, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers FROM r JOIN q USING (l_returnflag) GROUP BY 1""")
def box_statistics(spark, sf_dir):
    return rounded(checks.box_stats(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4)


@query("""WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT *, least(30, ceil(sqrt(n)))::BIGINT AS k, (hi - lo) / least(30, ceil(sqrt(n))) AS w FROM s),
c AS (SELECT greatest(0, least(k - 1, floor((o_totalprice - lo) / w)))::BIGINT AS bin, count(*) AS n FROM orders, b GROUP BY 1), g AS (SELECT t.i AS bin, lo + t.i * w AS a, CASE WHEN t.i = k - 1 THEN hi + 0.001 ELSE lo + (t.i + 1) * w END AS z FROM b, range(30) t(i) WHERE t.i < k)
SELECT g.bin::BIGINT AS bin, round(a, 4) AS start, round(z, 4) AS "end", coalesce(n, 0)::BIGINT AS n, CASE WHEN (a + z) / 2 >= 300000 THEN 'high' WHEN (a + z) / 2 >= 100000 THEN 'moderate' END AS band FROM g LEFT JOIN c ON c.bin = g.bin""")
def indicator_histogram(spark, sf_dir):
    return rounded(checks.indicator_histogram(read(spark, sf_dir, "orders"), "o_totalprice", [(100_000, "moderate"), (300_000, "high")]), 4)


@query("SELECT any_value(n)::BIGINT AS n, round(avg(v), 6) AS mean, max(v) FILTER (i = n // 2) AS median FROM (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part)")
def histogram_caption(spark, sf_dir):
    return rounded(checks.caption(read(spark, sf_dir, "part"), "p_retailprice"))


_LIMITS = {"l_discount": 0.02, "l_tax": 0.01}
_MODES = {"half-min": "m / 2", "small-constant": "0.65 * m", "custom": "0.003", "half-dl": None}


def _zero_sql(mode: str, value: str | None) -> str:
    other = {c: value or (repr(_LIMITS[c] / 2) if c in _LIMITS else "m / 2") for c in PARTS}
    return f"SELECT '{mode}' AS mode, " + ", ".join(f"round(sum(CASE WHEN {c} > 0 THEN {c} ELSE {other[c]} END), 4) AS {c}" for c in PARTS) + " FROM lineitem, m"


@query("WITH m AS (SELECT least(" + ", ".join(f"min(CASE WHEN {c} > 0 THEN {c} END)" for c in PARTS) + ") AS m FROM lineitem) " + " UNION ALL ".join(_zero_sql(m, v) for m, v in _MODES.items()))
def zero_replacement_modes(spark, sf_dir):
    lines, out = read(spark, sf_dir, "lineitem"), None
    for mode in _MODES:
        made = compose.replaced(lines, PARTS, mode, 0.003 if mode == "custom" else None, _LIMITS)
        row = made.agg(*[F.sum(c).alias(c) for c in PARTS]).select(F.lit(mode).alias("mode"), *PARTS)
        out = row if out is None else out.union(row)
    return rounded(out, 4)


_CLR = "c AS (SELECT " + ", ".join(f"ln({c}) - ({' + '.join(f'ln({x})' for x in PARTS)}) / 4 AS {c}" for c in PARTS) + " FROM lineitem WHERE " + " AND ".join(f"{c} > 0" for c in PARTS) + ")"


@query(f"WITH {_CLR} " + " UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(covar_samp({a}, {b}), 6) AS covariance, round(corr({a}, {b}), 6) AS correlation FROM c" for i, a in enumerate(PARTS) for b in PARTS[i:]))
def clr_covariance(spark, sf_dir):
    return rounded(compose.clr_covariance(read(spark, sf_dir, "lineitem"), PARTS))


@query(None)
def log_ratio_axes(spark, sf_dir):
    return rounded(compose.log_ratio_analysis(read(spark, sf_dir, "lineitem"), PARTS), 5)


_GOODS = {"a": "s_acctbal + 2000", "b": "s_nationkey + 1", "c": "s_suppkey % 17 + 2"}


@query("WITH s AS (SELECT s_suppkey AS i, " + ", ".join(f"ln({x}) AS {n}" for n, x in _GOODS.items()) + """ FROM supplier), l AS (SELECT i, a, b, c, (a + b + c) / 3 AS m FROM s), d AS (SELECT sqrt((x.a - x.m - y.a + y.m) ** 2 + (x.b - x.m - y.b + y.m) ** 2 + (x.c - x.m - y.c + y.m) ** 2) AS e,
sqrt((x.b - x.a - y.b + y.a) ** 2 + (x.c - x.a - y.c + y.a) ** 2) AS da, sqrt((x.a - x.b - y.a + y.b) ** 2 + (x.c - x.b - y.c + y.b) ** 2) AS db, sqrt((x.a - x.c - y.a + y.c) ** 2 + (x.b - x.c - y.b + y.c) ** 2) AS dc FROM l x JOIN l y ON x.i < y.i)
SELECT 'a' AS reference, round(corr(e, da), 6) AS correlation FROM d UNION ALL SELECT 'b', round(corr(e, db), 6) FROM d UNION ALL SELECT 'c', round(corr(e, dc), 6) FROM d""")
def alr_references(spark, sf_dir):
    """Up to a thousand rows are compared in all pairs; the bound is the operator's parameter."""
    goods = read(spark, sf_dir, "supplier").selectExpr(*[f"cast({x} as double) as {n}" for n, x in _GOODS.items()])
    return rounded(compose.reference_ranking(goods, list(_GOODS)))


@query("""WITH a AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x, l_discount AS z, l_extendedprice - regr_intercept(l_extendedprice, l_quantity) OVER () - regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity AS r FROM lineitem),
b AS (SELECT l_returnflag, y, r - regr_intercept(r, z) OVER () - regr_slope(r, z) OVER () * z AS r FROM a), m AS (SELECT avg(y) AS m FROM b) SELECT l_returnflag, round(avg(r), 4) AS residual, round(avg(m + r), 4) AS adjusted, round(stddev_samp(r), 4) AS spread FROM b, m GROUP BY 1""")
def adjusted_residuals(spark, sf_dir):
    made, _ = robust.adjusted(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "ols")
    return rounded(made.groupBy("l_returnflag").agg(F.avg("residual").alias("residual"), F.avg("adjusted").alias("adjusted"), F.stddev_samp("residual").alias("spread")), 4)


_SUMMARY = ENTRIES["qc_element_summary"][1]


@query(f"WITH e AS ({_SUMMARY}) SELECT round(avg(score), 5) AS score, CASE WHEN avg(score) >= 95 THEN 'A' WHEN avg(score) >= 85 THEN 'B' WHEN avg(score) >= 75 THEN 'C' WHEN avg(score) >= 60 THEN 'D' ELSE 'F' END AS grade FROM e")
def qc_overall_grade(spark, sf_dir):
    return rounded(qaqc.overall_grade(qaqc.element_summary(samples(spark, sf_dir), "id", ["Au", "Cu"], limits={"Au": 30.0, "Cu": 8.0})), 5)


@query(f"""WITH e AS ({_SUMMARY}), f AS (SELECT 'poor accuracy of standards' AS finding, element FROM e WHERE standard_pct < 85 UNION ALL SELECT 'contaminated blanks', element FROM e WHERE blank_pct < 90 UNION ALL SELECT 'poor precision of duplicates', element FROM e WHERE duplicate_pct < 80
UNION ALL SELECT 'failing grade', element FROM e WHERE grade = 'F' UNION ALL SELECT 'marginal grade', element FROM e WHERE grade = 'D' AND NOT EXISTS (FROM e WHERE grade = 'F')), g AS (SELECT finding, string_agg(element, ',' ORDER BY element) AS elements FROM f GROUP BY 1)
SELECT * FROM g UNION ALL SELECT 'satisfactory', '' WHERE NOT EXISTS (FROM g)""")
def qc_recommendations(spark, sf_dir):
    found = qaqc.recommendations(qaqc.element_summary(samples(spark, sf_dir), "id", ["Au", "Cu"], limits={"Au": 30.0, "Cu": 8.0}))
    return found.withColumn("elements", F.array_join("elements", ","))


@query("""WITH t AS (SELECT l_returnflag, l_quantity AS a, l_tax * 100 AS b, l_discount * 100 AS c FROM lineitem), p AS (SELECT l_returnflag, 0.5 * (2 * c + a) / (a + b + c) AS x, sqrt(3) / 2 * a / (a + b + c) AS y, 100 * a / (a + b + c) AS pa, 100 * b / (a + b + c) AS pb, 100 * c / (a + b + c) AS pc FROM t)
SELECT l_returnflag, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(pa), 5) AS a, round(avg(CASE WHEN pa > 99.999 THEN 0 ELSE pb END), 5) AS b, round(avg(CASE WHEN pa > 99.999 THEN 0 ELSE pc END), 5) AS c FROM p GROUP BY 1""")
def ternary_places(spark, sf_dir):
    x, y = spatial.ternary_to_plane(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100)
    placed = read(spark, sf_dir, "lineitem").select("l_returnflag", x.alias("x"), y.alias("y"))
    back = dict(zip("abc", spatial.plane_to_ternary(F.col("x"), F.col("y")), strict=True))
    told = placed.withColumns(back).groupBy("l_returnflag").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), *[F.round(F.avg(c), 5).alias(c) for c in "abc"])
    return told


@query("""WITH k AS (SELECT s_nationkey, row_number() OVER w AS o, count(*) OVER (PARTITION BY s_nationkey) AS n, (s_acctbal + 1000) / 100 AS r FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)), p AS (SELECT s_nationkey, o, n, r * cos(2 * pi() * o / n) AS x, r * sin(2 * pi() * o / n) AS y FROM k),
e AS (SELECT a.s_nationkey, a.n, a.x, a.y, a.x * b.y - b.x * a.y AS w, (a.x + b.x) * (a.x * b.y - b.x * a.y) AS u, (a.y + b.y) * (a.x * b.y - b.x * a.y) AS v FROM p a JOIN p b ON a.s_nationkey = b.s_nationkey AND b.o = a.o % a.n + 1)
SELECT s_nationkey::BIGINT AS s_nationkey, any_value(n)::BIGINT AS corners, round(abs(sum(w)) / 2, 4) AS area, round(CASE WHEN abs(sum(w)) < 2e-4 THEN avg(x) ELSE sum(u) / (3 * sum(w)) END, 4) AS cx, round(CASE WHEN abs(sum(w)) < 2e-4 THEN avg(y) ELSE sum(v) / (3 * sum(w)) END, 4) AS cy FROM e GROUP BY 1""")
def polygon_measures(spark, sf_dir):
    """A polygon of each nation's suppliers: corners at even angles, their distance by balance."""
    from pyspark.sql import Window

    own = Window.partitionBy("s_nationkey")
    rows = read(spark, sf_dir, "supplier").withColumns({"o": F.row_number().over(own.orderBy("s_suppkey")), "n": F.count("*").over(own)})
    turn, reach = 2 * 3.141592653589793 * F.col("o") / F.col("n"), (F.col("s_acctbal") + 1000) / 100
    return rounded(spatial.polygon_measures(rows.select("s_nationkey", "o", (reach * F.cos(turn)).alias("x"), (reach * F.sin(turn)).alias("y")), ["s_nationkey"], "o", "x", "y"), 4)
