"""Queries of profiles, ranks, hole summaries, ratio rankings and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.operators import profiles
from corelode.plans.registry import query, read, rounded

PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT 'ok' AS part, count(*) FILTER (s LIKE '>%')::BIGINT AS over, round(sum(v), 4) AS total FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN '< 1,0' || l_linenumber WHEN 1 THEN '>' || l_quantity WHEN 2 THEN '--' ELSE ' ' || l_tax END AS s, CASE l_linenumber % 4 WHEN 0 THEN 100 + 0 * l_linenumber + CASE WHEN l_linenumber = 4 THEN 4 ELSE l_linenumber END WHEN 1 THEN l_quantity WHEN 2 THEN NULL ELSE l_tax END AS v FROM lineitem)")
def loose_numbers(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(F.lit("< 1,0"), F.col("l_linenumber").cast("string"))).when(k == 1, F.concat(F.lit(">"), F.col("l_quantity").cast("string"))).when(k == 2, "--").otherwise(F.concat(F.lit(" "), F.col("l_tax").cast("string")))
    rows = read(spark, sf_dir, "lineitem").select(text.alias("s"))
    return rounded(rows.agg(F.lit("ok").alias("part"), F.count(F.when(F.col("s").startswith(">"), 1)).alias("over"), F.sum(profiles.loose_number(F.col("s"))).alias("total")), 4)


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_returnflag, round(avg((l_extendedprice - lo) / (hi - lo)), 6) AS own, round(avg(greatest(0, least(1, (l_quantity - 10) / 30))), 6) AS clamped,
round(avg(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 0.5 ELSE 1 END), 6) AS ranged, round(avg(CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 ELSE 0.5 END), 6) AS category FROM lineitem, b GROUP BY 1""")
def value_ranks(spark, sf_dir):
    rows = profiles.linear_rank(read(spark, sf_dir, "lineitem"), "l_extendedprice", name="own")
    rows = profiles.linear_rank(rows, "l_quantity", 10.0, 40.0, "clamped")
    rows = rows.withColumns({"ranged": profiles.range_rank(F.col("l_quantity"), [(None, 10.0), (10.0, 30.0), (30.0, 45.0)]), "category": profiles.category_rank(F.col("l_linestatus"), ["F", "O"])})
    return rounded(rows.groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in ("own", "clamped", "ranged", "category")]))


def _holes(spark, sf_dir):
    """Assays of a hole every two metres by order, logs of uneven length by part."""
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("hole"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    assays = lines.where("l_linenumber % 2 = 0").groupBy("hole", "l_orderkey").agg(F.min("l_quantity").alias("q"))
    left = assays.select("hole", F.col("l_orderkey").alias("row_id"), (F.col("l_orderkey") % 500).cast("double").alias("from"), (F.col("l_orderkey") % 500 + 2).cast("double").alias("to"))
    logs = lines.where("l_linenumber = 1").groupBy("hole", "l_orderkey").agg(F.min("l_quantity").alias("q"))
    right = logs.where("hole % 5 > 0").select("hole", F.col("l_orderkey").alias("log_id"), (F.col("l_orderkey") % 480).cast("double").alias("from"), (F.col("l_orderkey") % 480 + F.col("q") % 5).cast("double").alias("to"), F.when(F.col("q") > 25, "a").otherwise("b").alias("category"))
    return left, right


@query("""WITH x AS (SELECT l_orderkey % 97 AS hole, l_orderkey, min(l_quantity) FILTER (l_linenumber % 2 = 0) AS q, min(l_quantity) FILTER (l_linenumber = 1) AS p FROM lineitem GROUP BY 1, 2),
a AS (SELECT hole, l_orderkey AS i, (l_orderkey % 500)::DOUBLE AS f, (l_orderkey % 500 + 2)::DOUBLE AS t FROM x WHERE q IS NOT NULL), l AS (SELECT hole, l_orderkey AS i, (l_orderkey % 480)::DOUBLE AS f, (l_orderkey % 480 + p % 5)::DOUBLE AS t FROM x WHERE p IS NOT NULL AND hole % 5 > 0),
m AS (SELECT a.hole, a.i, max(CASE WHEN l.i IS NULL THEN 0 ELSE greatest(0, least(a.t, l.t) - greatest(a.f, l.f)) / 2 * 100 END) AS pct FROM a LEFT JOIN l ON a.hole = l.hole AND l.f < a.t AND a.f < l.t GROUP BY 1, 2),
g AS (SELECT hole, count(*) FILTER (s > 0.001) AS gaps, count(*) FILTER (s < -0.001) AS crossed FROM (SELECT hole, lead(f) OVER (PARTITION BY hole ORDER BY f, t, i) - t AS s FROM l) GROUP BY 1)
SELECT m.hole, count(*)::BIGINT AS assays, count(*) FILTER (pct > 0)::BIGINT AS matched, count(*) FILTER (pct > 0 AND pct < 50)::BIGINT AS low, round_even(100.0 * count(*) FILTER (pct > 0) / count(*), 1) AS match_pct, round_even(coalesce(avg(pct) FILTER (pct > 0), 0), 1) AS avg_overlap_pct,
coalesce(any_value(gaps), 0)::BIGINT AS gaps, coalesce(any_value(crossed), 0)::BIGINT AS "overlaps" FROM m LEFT JOIN g USING (hole) GROUP BY 1""")
def hole_match_summary(spark, sf_dir):
    return rounded(profiles.match_summary(*_holes(spark, sf_dir)))


@query("""WITH r AS (SELECT o_custkey % 50 AS hole, o_orderkey AS depth, o_totalprice AS v FROM orders), w AS (SELECT hole, depth, v, lead(depth) OVER w - depth AS thickness, avg(v) OVER (PARTITION BY hole ORDER BY depth, v ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM r WINDOW w AS (PARTITION BY hole ORDER BY depth, v))
SELECT hole, count(*)::BIGINT AS n, sum(thickness)::BIGINT AS depth, round(avg(smooth), 4) AS smooth FROM w GROUP BY 1""")
def downhole_profiles(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("hole"), F.col("o_orderkey").alias("depth"), F.col("o_totalprice").alias("v"))
    told = profiles.downhole_profile(rows, "hole", "depth", ["v"])
    return rounded(told.groupBy("hole").agg(F.count("*").alias("n"), F.sum("thickness").alias("depth"), F.avg("smooth").alias("smooth")), 4)


_PAIRS = [(a, b) for i, a in enumerate(PARTS) for b in PARTS[i + 1 :]]


@query("WITH p AS (SELECT l_returnflag AS g, " + ", ".join(f"ln({a} / {b}) AS r{k}" for k, (a, b) in enumerate(_PAIRS)) + " FROM lineitem WHERE " + " AND ".join(f"{c} > 0" for c in PARTS) + "), s AS (SELECT *, " + " + ".join(f"r{k}" for k in range(6)) + " AS every FROM p), m AS (SELECT g, count(*) AS n, " + ", ".join(f"avg(r{k}) AS m{k}" for k in range(6))
       + " FROM s GROUP BY 1), t AS (" + " UNION ALL ".join(f"SELECT '{a}/{b}' AS ratio, var_samp(r{k}) AS v, corr(r{k}, every - r{k}) ** 2 AS e, (SELECT sum(n * (m{k} - (SELECT avg(r{k}) FROM s)) ** 2) FROM m) / (var_pop(r{k}) * count(*)) AS b FROM s" for k, (a, b) in enumerate(_PAIRS))
       + ") SELECT ratio, round(v, 6) AS variance, round(100 * v / sum(v) OVER (), 6) AS contributed, round(100 * e, 5) AS explained, round(100 * b, 6) AS between FROM t QUALIFY row_number() OVER (ORDER BY v DESC, ratio) <= 4")
def top_ratios(spark, sf_dir):
    """The four log-ratios of most variance: a top-k report."""
    found = profiles.ratio_ranking(read(spark, sf_dir, "lineitem"), PARTS, "l_returnflag", 4)
    return rounded(found).withColumn("explained", F.round("explained", 5))


@query("WITH n AS (SELECT l_returnflag, l_quantity / 0.237 AS la, l_tax / 0.613 AS ce, l_discount / 0.161 AS yb FROM lineitem) SELECT l_returnflag, 0 AS place, 'La' AS element, round(avg(la), 5) AS value FROM n GROUP BY 1 UNION ALL SELECT l_returnflag, 1, 'Ce', round(avg(ce), 5) FROM n GROUP BY 1 UNION ALL SELECT l_returnflag, 2, 'Yb', round(avg(yb), 5) FROM n GROUP BY 1")
def spider_means(spark, sf_dir):
    rows = profiles.spider_rows(read(spark, sf_dir, "lineitem"), ["l_returnflag"], {"La": "l_quantity", "Ce": "l_tax", "Yb": "l_discount"}, "mcdonough-sun-1995")
    return rounded(rows.groupBy("l_returnflag", "place", "element").agg(F.avg("value").alias("value")), 5)


@query("SELECT count(*)::BIGINT AS n, round(min(c_acctbal) - 0.05 * (max(c_acctbal) - min(c_acctbal)), 4) AS x0, round(min(c_nationkey) - 0.05 * (max(c_nationkey) - min(c_nationkey)), 4) AS y0, round(max(c_acctbal) + 0.05 * (max(c_acctbal) - min(c_acctbal)), 4) AS x1, round(max(c_nationkey) + 0.05 * (max(c_nationkey) - min(c_nationkey)), 4) AS y1, round(avg(c_acctbal), 4) AS cx, round(avg(c_nationkey), 4) AS cy FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 2 AND 20")
def place_extent(spark, sf_dir):
    some = profiles.inside_extent(read(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey", (0.0, 2.0, 5000.0, 20.0))
    return rounded(profiles.extent(some, "c_acctbal", "c_nationkey"), 4)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, min(CASE WHEN {c} > 0 THEN {c} END)::DOUBLE AS low_positive FROM lineitem""" for c in PARTS))
def plot_ranges(spark, sf_dir):
    return rounded(profiles.plot_ranges(read(spark, sf_dir, "lineitem"), PARTS))


@query("SELECT place::BIGINT AS place, c AS \"column\", known::BIGINT AS known, missing::BIGINT AS missing FROM (" + " UNION ALL ".join(f"SELECT {k} AS place, '{c}' AS c, count({c}) AS known, count(*) - count({c}) AS missing FROM events" for k, c in enumerate(("event_id", "ts", "user_id", "event_type", "value", "props"))) + ")")
def column_profiles(spark, sf_dir):
    """Exact counts; the estimate of distinct values is left out here."""
    return rounded(profiles.column_profile(read(spark, sf_dir, "events")).select("place", "column", "known", "missing"))
