"""Queries of clusters, populations, robust fits and learners; the rounds are written out in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.operators import clusters, learning, populations, robust
from corelode.plans.registry import query, read, rounded

PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LOGS = [f"ln(greatest({c}, 1e-10))" for c in PARTS]
_CLR = "f AS (SELECT row_number() OVER () AS i, l_linenumber, l_returnflag, " + ", ".join(f"{x} - ({' + '.join(_LOGS)}) / 4 AS f{k}" for k, x in enumerate(_LOGS)) + " FROM lineitem)"
_MEANS = ", ".join(f"avg(f{k}) AS c{k}" for k in range(4))


def _rounds(classes: str, turns: int, tag: str = "") -> str:
    """Centres c0, c1, ... and assignments a1, a2, ... of k-means that starts from classes; a class without rows would keep its centre."""
    away = " + ".join(f"(f{k} - c{k}) ** 2" for k in range(4))
    out = [f"c{tag}0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s) - 1 AS c, {', '.join(f'c{k}' for k in range(4))} FROM (SELECT {classes} AS s, {_MEANS} FROM f GROUP BY 1))"]
    for t in range(1, turns + 1):
        out.append(f"a{tag}{t} AS MATERIALIZED (SELECT i, arg_min(c, ({away}, c)) AS c, min({away}) AS d2 FROM f, c{tag}{t - 1} GROUP BY i)")
        out.append(f"m{tag}{t} AS (SELECT a.c, {_MEANS} FROM a{tag}{t} a JOIN f USING (i) GROUP BY 1)")
        out.append(f"c{tag}{t} AS MATERIALIZED (SELECT o.c, {', '.join(f'coalesce(m.c{k}, o.c{k}) AS c{k}' for k in range(4))} FROM c{tag}{t - 1} o LEFT JOIN m{tag}{t} m ON m.c = o.c)")
    return ", ".join(out)


@query(f"""WITH {_CLR}, {_rounds('l_linenumber % 4', 4)} SELECT c::BIGINT AS cluster, l_returnflag, count(*)::BIGINT AS n, round(sum(d2), 4) AS inertia, {', '.join(f'round(any_value(c.c{k}), 5) AS centre_{k}' for k in range(4))}
FROM a4 JOIN f USING (i) JOIN c3 c USING (c) GROUP BY 1, 2""")
def k_means_clusters(spark, sf_dir):
    """Classes of log-ratios, refined from an existing classification; centres are those that the assignment was made with."""
    lines = read(spark, sf_dir, "lineitem")
    fit = clusters.k_means(lines, PARTS, 4, transform="clr", start=F.col("l_linenumber") % 4, rounds=4)
    told = fit.assign(lines).groupBy("cluster", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("distance") ** 2), 4).alias("inertia"))
    centres = spark.createDataFrame([(c, *map(float, v)) for c, v in enumerate(fit.centres)], "cluster int, " + ", ".join(f"centre_{k} double" for k in range(4)))
    return rounded(told.join(centres, "cluster"), 5)


@query(f"WITH {_CLR}, {', '.join(_rounds(f'l_linenumber % {k}', 3, f'_{k}_') for k in range(2, 6))}, e AS ({' UNION ALL '.join(f'SELECT {k} AS k, sum(d2) AS inertia FROM a_{k}_3' for k in range(2, 6))}), "
       "b AS (SELECT k, lag(inertia) OVER w - 2 * inertia + lead(inertia) OVER w AS bend FROM e WINDOW w AS (ORDER BY k)), "
       "x AS (SELECT coalesce(arg_max(k, bend) FILTER (bend > 0), 2) AS best FROM b) SELECT k::BIGINT AS k, round(inertia, 4) AS inertia, k = best AS chosen FROM e, x")  # fmt: skip
def k_means_elbow(spark, sf_dir):
    table, best = clusters.elbow(read(spark, sf_dir, "lineitem"), PARTS, range(2, 6), transform="clr", start=lambda k: F.col("l_linenumber") % k, rounds=3)
    return rounded(table.withColumn("chosen", F.col("k") == best), 4)


@query(None)
def k_means_silhouette(spark, sf_dir):
    """Classes of log-ratios by drawn starts, and the silhouettes of 500 rows against all rows."""
    lines = read(spark, sf_dir, "lineitem")
    told = clusters.silhouettes(lines, clusters.k_means(lines, PARTS, 4, transform="clr", restarts=3, rounds=20))
    return rounded(told.groupBy("cluster").agg(F.count("*").alias("asked"), F.avg("silhouette").alias("silhouette")))


@query(None)
def population_mixture(spark, sf_dir):
    """Fitted until settled, in 100 rounds at most.  Its SQL with the rounds written out did not end on larger tables; the tests hold mixtures against numpy."""
    return rounded(populations.populations(read(spark, sf_dir, "lineitem"), "l_quantity", 3)[0], 5)


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem), h AS (SELECT b, count(*) AS n FROM (SELECT least(49, floor((l_extendedprice - lo) / ((hi - lo) / 50))) AS b FROM lineitem, b) GROUP BY 1),
g AS (SELECT t.i, coalesce(n, 0) AS n FROM range(50) t(i) LEFT JOIN h ON b = i), s AS (SELECT i, n, avg(n) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM g),
p AS (SELECT *, lag(s) OVER (ORDER BY i) AS a, lead(s) OVER (ORDER BY i) AS z FROM s), k AS (SELECT i, n, s FROM p, b WHERE s > a AND s > z AND s > 0.02 * total ORDER BY s DESC, i LIMIT 4)
SELECT (row_number() OVER (ORDER BY i) - 1)::BIGINT AS mode, round(lo + (i + 0.5) * (hi - lo) / 50, 4) AS centre, n::BIGINT AS n, round(s / total, 6) AS density FROM k, b""")
def population_modes(spark, sf_dir):
    told = rounded(populations.histogram_modes(read(spark, sf_dir, "lineitem"), "l_extendedprice"))
    return told.withColumn("centre", F.round("centre", 4))


def _reweighting(kind: str, turns: int) -> str:
    weight = "CASE WHEN abs(u) <= 1.345 THEN 1 ELSE 1.345 / abs(u) END" if kind == "huber" else "CASE WHEN abs(u) <= 4.685 THEN (1 - (u / 4.685) ** 2) ** 2 ELSE 0 END"
    out = ["k0 AS MATERIALIZED (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t GROUP BY g)"]
    for n in range(1, turns + 1):
        out.append(f"r{n} AS MATERIALIZED (SELECT t.g, x, y, y - b * x - a AS r FROM t JOIN k{n - 1} USING (g))")
        out.append(f"s{n} AS (SELECT g, 1.4826 * median(abs(r - m)) AS s FROM r{n} JOIN (SELECT g, median(r) AS m FROM r{n} GROUP BY g) USING (g) GROUP BY g)")
        out.append(f"w{n} AS (SELECT g, x, y, {weight} AS w FROM (SELECT *, r / s AS u FROM r{n} JOIN s{n} USING (g)))")
        out.append(f"k{n} AS MATERIALIZED (SELECT g, b, (sum_wy - b * sum_wx) / sum_w AS a FROM (SELECT g, sum(w) AS sum_w, sum(w * x) AS sum_wx, sum(w * y) AS sum_wy, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) ** 2 / sum(w)) AS b FROM w{n} GROUP BY g))")
    out.append(f"r AS MATERIALIZED (SELECT t.g, x, y, y - b * x - a AS r FROM t JOIN k{turns} USING (g)), s AS (SELECT g, 1.4826 * median(abs(r - m)) AS s FROM r JOIN (SELECT g, median(r) AS m FROM r GROUP BY g) USING (g) GROUP BY g)")
    return ", ".join(out)


def _robust_sql(kind: str, group: str) -> str:
    return f"""WITH t AS (SELECT {group} AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), {_reweighting(kind, 2)}
SELECT g, round(any_value(b), 3) AS slope, round(any_value(a), 3) AS intercept, round(1 - sum(r * r) / (regr_syy(y, x)), 5) AS r2, round(any_value(s), 3) AS scale, round(any_value(s) / sqrt(regr_sxx(y, x)), 4) AS slope_se,
round(any_value(s) * sqrt(1.0 / count(*) + avg(x) ** 2 / regr_sxx(y, x)), 3) AS intercept_se, count(*)::BIGINT AS n FROM r JOIN s USING (g) JOIN k2 USING (g) GROUP BY g"""


def _digits(df):
    places = {"slope": 3, "intercept": 3, "r2": 5, "scale": 3, "slope_se": 4, "intercept_se": 3}
    return rounded(df).withColumns({c: F.round(c, n) for c, n in places.items()})


@query(_robust_sql("huber", "'all'"))
def regression_huber(spark, sf_dir):
    return _digits(robust.reweighted(read(spark, sf_dir, "lineitem").withColumn("g", F.lit("all")), "l_quantity", "l_extendedprice", "huber", ["g"], rounds=2))


@query(_robust_sql("bisquare", "l_returnflag"))
def regression_bisquare_by_group(spark, sf_dir):
    return _digits(robust.reweighted(read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_extendedprice", "bisquare", ["g"], rounds=2))


def _trimming(turns: int) -> str:
    out = ["k0 AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t)"]
    for n in range(1, turns + 1):
        out.append(f"r{n} AS MATERIALIZED (SELECT x, y, (y - b * x - a) ** 2 AS r2 FROM t, k{n - 1})")
        out.append(f"h{n} AS MATERIALIZED (SELECT x, y FROM (SELECT *, row_number() OVER (ORDER BY r2) AS turn FROM r{n}) WHERE turn <= (SELECT floor(0.75 * count(*)) FROM t))")
        out.append(f"k{n} AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM h{n})")
    return ", ".join(out)


@query(f"""WITH t AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), {_trimming(3)} SELECT round(b, 5) AS slope, round(a, 4) AS intercept, round((SELECT sum((y - b * x - a) ** 2) FROM h3), 2) AS trimmed_ss, (SELECT count(*) FROM t)::BIGINT AS n FROM k3""")
def regression_trimmed(spark, sf_dir):
    """Three steps from the least-squares line; by default the search starts from pairs of rows."""
    told = robust.trimmed(read(spark, sf_dir, "part"), "p_size", "p_retailprice", start="ols", steps=2)
    return rounded(told.select(F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("trimmed_ss", 2).alias("trimmed_ss"), "n"))


_D2 = "(b * (x - mx) ** 2 - 2 * c * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * b - c * c)"
_COV = "SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM"


@query(f"""WITH t AS (SELECT o_orderkey, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders), s AS ({_COV} t), d AS (SELECT t.*, {_D2} AS d2 FROM t, s),
h AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY d2) AS turn FROM d) WHERE turn <= (SELECT floor(0.75 * count(*)) FROM t)), z AS ({_COV} h), e AS (SELECT o_orderkey, sqrt({_D2}) AS distance FROM t, z)
SELECT o_orderkey, round(distance, 5) AS distance, distance > {robust.chi_square_cutoff(2) ** 0.5!r} AS is_anomaly FROM e""")
def mahalanobis_trimmed(spark, sf_dir):
    found = robust.trimmed_mahalanobis(read(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
    return rounded(found.select("o_orderkey", "distance", "is_anomaly"), 5)


def _labelled(spark, sf_dir):
    """Lines with a class that their columns decide but for every ninth."""
    kind = F.when(F.col("l_partkey") % 9 == 0, "other").when(F.col("l_quantity") > 30, F.when(F.col("l_discount") > 0.05, "high").otherwise("middle")).otherwise("low")
    return read(spark, sf_dir, "lineitem").withColumn("kind", kind)


@query(None)
def decision_tree_rules(spark, sf_dir):
    fit = learning.grow(_labelled(spark, sf_dir), "kind", learning.raw_features(PARTS), _KEY, max_depth=4)
    return spark.createDataFrame([(k, r) for k, r in enumerate(fit.rules())], "leaf int, rule string")


@query(None)
def random_forest_scores(spark, sf_dir):
    """A forest of log-ratios: scores of the votes out of bag on the training part, and of all votes on the rest."""
    rows = learning.split(_labelled(spark, sf_dir), "kind", _KEY)
    fit = learning.grow(rows.where("train"), "kind", learning.ratio_features(PARTS) | learning.raw_features(["l_quantity", "l_discount"]), _KEY, trees=8, share=0.5, bootstrap=True, max_depth=5)
    bag, rest = fit.vote(rows.where("train"), out_of_bag=True), fit.vote(rows.where("not train"))
    told = lambda df, name: learning.score_summary(df.where("prediction is not null"), "kind", "prediction").withColumn("part", F.lit(name))
    return rounded(told(bag, "out of bag").union(told(rest, "test")))


@query(None)
def logistic_folds(spark, sf_dir):
    lines = _labelled(spark, sf_dir)
    return rounded(learning.cross_validated(lines, "kind", _KEY, lambda rows: learning.fit_logistic(rows, "kind", learning.raw_features(PARTS), rounds=12), 3))


def _logistic(turns: int, classes: list[str], names: list[str]) -> str:
    """Weights w0, w1, ... of gradient steps of rate 0.5 falling by 0.99."""
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS x{k}" for k, c in enumerate(names))
    weights = [f"b{c}_{k}" for c in range(len(classes)) for k in range(len(names) + 1)]
    out = [f"x AS MATERIALIZED (SELECT kind, {scaled} FROM t)", f"w0 AS (SELECT {', '.join(f'0.0::DOUBLE AS {w}' for w in weights)})"]
    score = [" + ".join([f"b{c}_0"] + [f"b{c}_{k + 1} * x{k}" for k in range(len(names))]) for c in range(len(classes))]
    for t in range(1, turns + 1):
        total = " + ".join(f"exp({s})" for s in score)
        off = [f"((kind = '{name}')::INT - exp({score[c]}) / ({total}))" for c, name in enumerate(classes)]
        steps = [f"any_value(b{c}_{k}) + {0.5 * 0.99 ** (t - 1)!r} * avg({off[c]} * {'1' if k == 0 else f'x{k - 1}'}) AS b{c}_{k}" for c in range(len(classes)) for k in range(len(names) + 1)]
        out.append(f"w{t} AS MATERIALIZED (SELECT {', '.join(steps)} FROM x, w{t - 1})")
    return ", ".join(out)


_KINDS, _X = ["high", "low", "middle", "other"], ["l_quantity", "l_discount"]


@query(f"""WITH t AS (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN 'other' WHEN l_quantity > 30 THEN CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'middle' END ELSE 'low' END AS kind FROM lineitem), {_logistic(5, _KINDS, _X)}
{' UNION ALL '.join(f"SELECT '{name}' AS class, round(b{c}_0, 6) AS intercept, round(b{c}_1, 6) AS l_quantity, round(b{c}_2, 6) AS l_discount FROM w5" for c, name in enumerate(_KINDS))}""")
def logistic_weights(spark, sf_dir):
    fit = learning.fit_logistic(_labelled(spark, sf_dir), "kind", learning.raw_features(_X), rounds=5)
    return rounded(spark.createDataFrame([(c, *map(float, w)) for c, w in zip(fit.classes, fit.weights, strict=True)], "class string, intercept double, l_quantity double, l_discount double"))
