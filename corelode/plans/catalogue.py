"""All registered queries of the assay operators, with their SQL, over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelode.functions import formula, petrology
from corelode.operators import compose, drill, multivariate, qaqc, spatial, stats
from corelode.plans import calculation_queries, check_queries, learning_queries, profile_queries, quality_queries, space_queries, statistics_queries, table_queries  # noqa: F401  register their queries
from corelode.plans.registry import ENTRIES, query, read, rounded

PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def queries() -> dict:
    return {k: f for k, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ENTRIES.items() if sql}


@query("""SELECT l_returnflag, count(v)::BIGINT AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median
FROM (SELECT l_returnflag, CASE WHEN l_discount + l_tax = 0 THEN NULL ELSE 100 * l_discount / (l_discount + l_tax) END AS v FROM lineitem) GROUP BY ALL""")
def formula_summary(spark, sf_dir):
    v = formula.compile_formula("100*{l_discount}/({l_discount}+{l_tax})")
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", v.alias("v"))
    return rounded(stats.summary_stats(df, ["v"], ["l_returnflag"]).select("l_returnflag", "n", "mean", "median"))


@query("""SELECT 'x' AS name, round(avg(power(-2, 2)), 6) AS a, round(avg(power(power(l_quantity, 0.5), 2)), 6) AS b, round(avg(log10(l_quantity) + ln(l_quantity)), 6) AS c,
round(avg(CASE WHEN l_discount > 0 THEN log10(l_discount) END), 6) AS d, round(avg(greatest(l_tax, l_discount) - least(l_tax, l_discount)), 6) AS e FROM lineitem""")
def formula_functions(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    texts = {"a": "-2^2", "b": "l_quantity^0.5^2", "c": "log(l_quantity)+ln(l_quantity)", "d": "log10(l_discount)", "e": "max(l_tax,l_discount)-min(l_tax,l_discount)"}
    return rounded(df.agg(F.lit("x").alias("name"), *[F.avg(formula.compile_formula(t)).alias(k) for k, t in texts.items()]))


@query("""WITH t AS (SELECT l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '<' || l_tax WHEN 1 THEN '>' || l_quantity WHEN 2 THEN 'BDL' WHEN 3 THEN l_quantity || 'abc' ELSE l_tax::VARCHAR END AS s, l_tax, l_quantity FROM lineitem)
SELECT l_linenumber::BIGINT AS l_linenumber, count(v)::BIGINT AS n, round(sum(v), 4) AS total FROM (SELECT l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN l_tax / 2 WHEN 1 THEN l_quantity WHEN 2 THEN NULL WHEN 3 THEN l_quantity ELSE l_tax END AS v FROM t) GROUP BY ALL""")
def censored_values(spark, sf_dir):
    k = F.col("l_linenumber") % 5
    text = F.when(k == 0, F.concat(F.lit("<"), F.col("l_tax").cast("string"))).when(k == 1, F.concat(F.lit(">"), F.col("l_quantity").cast("string"))).when(k == 2, "BDL")
    text = text.when(k == 3, F.concat(F.col("l_quantity").cast("string"), F.lit("abc"))).otherwise(F.col("l_tax").cast("string"))
    df = read(spark, sf_dir, "lineitem").select("l_linenumber", formula.parse_censored(text).alias("v"))
    return rounded(df.groupBy("l_linenumber").agg(F.count("v").alias("n"), F.sum("v").alias("total")), 4)


_STATS = ", ".join(f"round({f}, 6) AS {n}" for f, n in [("min(v)", '"min"'), ("max(v)", '"max"'), ("avg(v)", "mean"), ("stddev_samp(v)", "std")] + [(f"quantile_cont(v, {p})", n) for p, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"))])


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(v)::BIGINT AS n, {_STATS} FROM (SELECT {c}::DOUBLE AS v FROM lineitem)" for c in PARTS))
def summary_stats(spark, sf_dir):
    return rounded(stats.summary_stats(read(spark, sf_dir, "lineitem"), PARTS))


@query(" UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(corr({a}, {b}), 6) AS r, count(*)::BIGINT AS n FROM lineitem" for k, a in enumerate(PARTS) for b in PARTS[k + 1 :]))
def correlation_matrix(spark, sf_dir):
    return rounded(stats.correlations(read(spark, sf_dir, "lineitem"), PARTS))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT 'l_quantity' AS col_i, 'l_extendedprice' AS col_j, round(corr(a, b), 6) AS r, count(*)::BIGINT AS n FROM r""")
def spearman_correlation(spark, sf_dir):
    return rounded(stats.spearman(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""WITH s AS (SELECT event_type, avg(value) m, stddev_samp(value) d FROM events GROUP BY 1)
SELECT event_id, round(abs(value - m) / d, 6) AS score, abs(value - m) / d > 2 AS anomaly FROM events JOIN s USING (event_type)""")
def anomaly_sigma(spark, sf_dir):
    return rounded(stats.anomaly_sigma(read(spark, sf_dir, "events"), "value", 2.0, ["event_type"]).select("event_id", "score", "anomaly"))


@query("""WITH m AS (SELECT median(p_retailprice) c FROM part), d AS (SELECT median(abs(p_retailprice - c)) s FROM part, m)
SELECT p_partkey, round(abs(p_retailprice - c) / (1.4826 * s), 6) AS score, abs(p_retailprice - c) / (1.4826 * s) > 1.2 AS anomaly FROM part, m, d""")
def anomaly_mad(spark, sf_dir):
    return rounded(stats.anomaly_mad(read(spark, sf_dir, "part"), "p_retailprice", 1.2).select("p_partkey", "score", "anomaly"))


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.5) m, quantile_cont(c_acctbal, 0.75) b FROM customer GROUP BY 1)
SELECT c_custkey, round(abs(c_acctbal - m) / (b - a), 6) AS score, c_acctbal < a - 0.3 * (b - a) OR c_acctbal > b + 0.3 * (b - a) AS anomaly FROM customer JOIN q USING (c_mktsegment)""")
def anomaly_iqr(spark, sf_dir):
    return rounded(stats.anomaly_iqr(read(spark, sf_dir, "customer"), "c_acctbal", 0.3, ["c_mktsegment"]).select("c_custkey", "score", "anomaly"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n,
round(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / (count(*) - 2)), 4) AS se FROM lineitem GROUP BY 1""")
def regression_by_group(spark, sf_dir):
    return rounded(stats.regression(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 4)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*)::BIGINT AS total, count({c})::BIGINT AS valid, count(*) FILTER ({c} < 0)::BIGINT AS negative, round(min({c}), 6)::DOUBLE AS \"min\", round(max({c}), 6)::DOUBLE AS \"max\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, (SELECT count(*) FROM lineitem, (SELECT avg({c}) m, stddev_pop({c}) s FROM lineitem) WHERE abs({c} - m) > 3 * s)::BIGINT AS outliers, (count(*) - count({c}))::BIGINT AS null_count FROM lineitem" for c in PARTS))
def data_quality(spark, sf_dir):
    return rounded(stats.data_quality(read(spark, sf_dir, "lineitem"), PARTS))


_ZERO = "(SELECT least(min(CASE WHEN l_quantity > 0 THEN l_quantity END), min(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END), min(CASE WHEN l_discount > 0 THEN l_discount END), min(CASE WHEN l_tax > 0 THEN l_tax END)) / 2 AS h FROM lineitem)"
_FIXED = ", ".join(f"CASE WHEN {c} > 0 THEN {c}::DOUBLE ELSE h END AS {c}" for c in PARTS)
_MEAN = "(" + " + ".join(f"ln({c})" for c in PARTS) + ") / 4"


@query(f"SELECT l_returnflag, {', '.join(f'round(avg(ln({c}) - {_MEAN}), 6) AS clr_{c}' for c in PARTS)} FROM (SELECT l_returnflag, {_FIXED} FROM lineitem, {_ZERO}) GROUP BY 1")
def clr_transform(spark, sf_dir):
    df = compose.clr(compose.replace_zeros(read(spark, sf_dir, "lineitem"), PARTS), PARTS)
    return rounded(df.groupBy("l_returnflag").agg(*[F.avg(f"clr_{c}").alias(f"clr_{c}") for c in PARTS]))


@query(f"SELECT l_returnflag, {', '.join(f'round(avg(ln({c} / l_quantity)), 6) AS alr_{c}' for c in PARTS[1:])}, round(avg(sqrt(3.0 / 4) * (ln(l_quantity) - (ln(l_extendedprice) + ln(l_discount) + ln(l_tax)) / 3)), 6) AS ilr_1, round(avg(ln((l_discount + l_tax) / (l_quantity + l_extendedprice))), 6) AS slr FROM (SELECT l_returnflag, {_FIXED} FROM lineitem, {_ZERO}) GROUP BY 1")
def logratio_transforms(spark, sf_dir):
    df = compose.replace_zeros(read(spark, sf_dir, "lineitem"), PARTS)
    df = compose.slr(compose.ilr(compose.alr(df, PARTS, "l_quantity"), PARTS), PARTS[2:], PARTS[:2], "slr")
    return rounded(df.groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in [*(f"alr_{p}" for p in PARTS[1:]), "ilr_1", "slr"]]))


@query(" UNION ALL ".join(f"SELECT '{a}' AS part_i, '{b}' AS part_j, round(var_samp(ln({a} / {b})), 6) AS variance FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_discount > 0 AND l_tax > 0" for k, a in enumerate(PARTS) for b in PARTS[k + 1 :]))
def variation_matrix(spark, sf_dir):
    return rounded(compose.variation(read(spark, sf_dir, "lineitem"), PARTS))


def _intervals(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*ALL_LINE)
    df = read(spark, sf_dir, "lineitem")
    to = F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    n = F.row_number().over(order)
    df = df.select(F.col("l_orderkey").alias("hole"), n.alias("n"), (to - F.col("l_quantity")).alias("from"), to.alias("to"), "l_returnflag", "l_linenumber", "l_extendedprice")
    return df.withColumn("row_id", F.concat_ws("-", "hole", "n"))


def _logging(spark, sf_dir) -> DataFrame:
    df = _intervals(spark, sf_dir)
    start = (7 * (F.col("l_linenumber") - 1)).cast("double")
    return df.select("hole", F.col("n").alias("log_id"), start.alias("from"), (start + 9).alias("to"), F.col("l_returnflag").alias("category"))


_LINES = f"""i AS (SELECT l_orderkey AS hole, row_number() OVER w AS n, (sum(l_quantity) OVER w - l_quantity)::DOUBLE AS f, (sum(l_quantity) OVER w)::DOUBLE AS t, l_returnflag AS cat, (7 * (l_linenumber - 1))::DOUBLE AS lf, l_extendedprice
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(ALL_LINE)} ROWS UNBOUNDED PRECEDING)),
o AS (SELECT a.hole, a.n, a.f, a.t, b.n AS log_id, b.cat, (least(a.t, b.lf + 9) - greatest(a.f, b.lf)) / (CASE WHEN a.t > a.f THEN a.t - a.f ELSE 1e-10 END) * 100 AS pct FROM i a JOIN i b ON a.hole = b.hole AND b.lf < a.t AND a.f < b.lf + 9)"""


@query(f"""WITH {_LINES}, best AS (SELECT hole, n, arg_max(cat, (pct, -log_id)) AS category, max(pct) AS pct FROM o WHERE pct > 0 GROUP BY 1, 2)
SELECT i.hole, i.n, category, round(coalesce(pct, 0), 6) AS pct FROM i LEFT JOIN best USING (hole, n)""")
def interval_max_overlap(spark, sf_dir):
    return rounded(drill.max_overlap(_intervals(spark, sf_dir), _logging(spark, sf_dir)).select("hole", "n", "category", "pct"))


@query(f"""WITH {_LINES}, c AS (SELECT hole, n, string_agg(DISTINCT cat, ' | ' ORDER BY cat) AS codes, max(CASE WHEN cat = 'A' THEN 'Yes' END) AS a, max(CASE WHEN cat = 'N' THEN 'Yes' END) AS b FROM o WHERE pct > 0 GROUP BY 1, 2)
SELECT i.hole, i.n, codes, coalesce(a, 'No') AS flag_A, coalesce(b, 'No') AS flag_N FROM i LEFT JOIN c USING (hole, n)""")
def interval_codes(spark, sf_dir):
    left, right = _intervals(spark, sf_dir), _logging(spark, sf_dir)
    found = drill.split_columns(drill.combine_codes(left, right), right, "flag", ["A", "N"])
    return rounded(found.select("hole", "n", "codes", "flag_A", "flag_N"))


_DEEP = f"""i AS (SELECT l_suppkey AS hole, row_number() OVER w AS n, (sum(l_quantity) OVER w - l_quantity)::DOUBLE AS f, (sum(l_quantity) OVER w)::DOUBLE AS t, l_returnflag AS cat, (23 * (row_number() OVER w - 1))::DOUBLE AS lf
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {', '.join(ALL_LINE)} ROWS UNBOUNDED PRECEDING)),
o AS (SELECT a.hole, a.n, b.n AS log_id, b.cat, (least(a.t, b.lf + 40) - greatest(a.f, b.lf)) / (CASE WHEN a.t > a.f THEN a.t - a.f ELSE 1e-10 END) * 100 AS pct FROM i a JOIN i b ON a.hole = b.hole AND b.lf < a.t AND a.f < b.lf + 40)"""


@query(f"""WITH {_DEEP}, best AS (SELECT hole, n, arg_max(cat, (pct, -log_id)) AS category, max(pct) AS pct, string_agg(DISTINCT cat, ' | ' ORDER BY cat) AS codes FROM o WHERE pct > 0 GROUP BY 1, 2)
SELECT i.hole, i.n, category, round(coalesce(pct, 0), 6) AS pct, codes FROM i LEFT JOIN best USING (hole, n)""")
def interval_overlap_deep(spark, sf_dir):
    """Holes of many intervals: each supplier's lines, against logs that overlap each other, met hole by hole."""
    # Columns get their names before the window: its rows are known to be dealt by hole, and both sides read the same ones.
    names = {"l_suppkey": "hole", "l_returnflag": "category"}
    lines = read(spark, sf_dir, "lineitem").withColumnsRenamed(names)
    order = Window.partitionBy("hole").orderBy(*[names.get(c, c) for c in ALL_LINE])
    to = F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    rows = lines.select("hole", F.row_number().over(order).alias("n"), (to - F.col("l_quantity")).alias("from"), to.alias("to"), "category")
    start = (23 * (F.col("n") - 1)).cast("double")
    logs = rows.select("hole", F.col("n").alias("log_id"), start.alias("from"), (start + 40).alias("to"), "category")
    left = rows.select("hole", F.col("n").alias("row_id"), "from", "to")
    return rounded(drill.matched(left, logs, deep=True).select("hole", F.col("row_id").alias("n"), "category", "pct", "codes"))


@query(f"""WITH {_LINES}, s AS (SELECT hole, lead(lf) OVER (PARTITION BY hole ORDER BY lf, lf + 9, n) - (lf + 9) AS step FROM i)
SELECT hole, count(*) FILTER (step > 0.001)::BIGINT AS gaps, count(*) FILTER (step < -0.001)::BIGINT AS overlaps FROM s GROUP BY 1""")
def logging_gaps(spark, sf_dir):
    return rounded(drill.gaps_and_overlaps(_logging(spark, sf_dir), ["log_id"]))


_SURVEY = f"""{_LINES},
s0 AS (SELECT DISTINCT l_orderkey AS hole, 10.0 * l_linenumber AS depth, 90.0 + 2 * l_linenumber AS az, -60.0 + l_linenumber AS dip FROM lineitem),
s AS (SELECT * FROM s0 UNION ALL SELECT hole, 0.0, min(az), min(dip) FROM s0 GROUP BY hole),
m AS (SELECT hole, depth, depth - lag(depth) OVER v AS d, radians((az + lag(az) OVER v) / 2) AS a, radians((dip + lag(dip) OVER v) / 2) AS p FROM s WINDOW v AS (PARTITION BY hole ORDER BY depth)),
p AS (SELECT m.hole, depth, o_totalprice + sum(coalesce(d * cos(p) * sin(a), 0)) OVER v AS x, o_custkey + sum(coalesce(d * cos(p) * cos(a), 0)) OVER v AS y, sum(coalesce(d * sin(p), 0)) OVER v AS z, row_number() OVER v AS k FROM m JOIN orders ON o_orderkey = m.hole WINDOW v AS (PARTITION BY m.hole ORDER BY depth ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, lead(depth) OVER v AS d2, lead(x) OVER v AS x2, lead(y) OVER v AS y2, lead(z) OVER v AS z2 FROM p WINDOW v AS (PARTITION BY hole ORDER BY depth)),
e AS (SELECT i.hole, i.n, i.f, i.t, coalesce(((f + t) / 2 - depth) / (d2 - depth), 0) AS share, q.*EXCLUDE (hole) FROM i JOIN q ON i.hole = q.hole AND (f + t) / 2 >= depth AND (d2 IS NULL OR (f + t) / 2 < d2))"""


def _surveyed(spark, sf_dir) -> DataFrame:
    collar = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hole"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    n = F.col("l_linenumber")
    survey = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole"), (10.0 * n).alias("depth"), (90.0 + 2 * n).alias("azimuth"), (-60.0 + n).alias("dip")).distinct()
    return drill.desurvey(collar, survey, _intervals(spark, sf_dir))


@query(f"WITH {_SURVEY} SELECT hole, n, round(x + share * (coalesce(x2, x) - x), 4) AS x, round(y + share * (coalesce(y2, y) - y), 4) AS y, round(z + share * (coalesce(z2, z) - z), 4) AS z FROM e")
def desurvey(spark, sf_dir):
    return rounded(_surveyed(spark, sf_dir).select("hole", "n", "x", "y", "z"), 4)


@query(f"""WITH {_SURVEY}, best AS (SELECT hole, n, arg_max(cat, (pct, -log_id)) AS category FROM o WHERE pct > 0 GROUP BY 1, 2)
SELECT category, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean_grade, round(avg(z + share * (coalesce(z2, z) - z)), 4) AS mean_z FROM e JOIN i USING (hole, n) LEFT JOIN best USING (hole, n) GROUP BY 1""")
def drill_grade_summary(spark, sf_dir):
    placed = drill.max_overlap(_surveyed(spark, sf_dir), _logging(spark, sf_dir))
    return rounded(placed.groupBy("category").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean_grade"), F.avg("z").alias("mean_z")), 4)


@query("""WITH l AS (SELECT event_type, avg(value) c, stddev_samp(value) s FROM events GROUP BY 1),
z AS (SELECT event_id, ts, event_type, value, (value - c) / s AS z FROM events JOIN l USING (event_type)),
g AS (SELECT *, sign(value - lag(value) OVER w) AS step FROM z WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN abs(z) > 3 THEN 'fail' WHEN abs(z) > 2 THEN 'warning' ELSE 'pass' END AS status,
count(z) OVER w2 = 2 AND (min(z) OVER w2 > 2 OR max(z) OVER w2 < -2) AS rule_2_2s, coalesce(abs(z - lag(z) OVER w) > 4, false) AS rule_r_4s,
count(z) OVER w4 = 4 AND (min(z) OVER w4 > 1 OR max(z) OVER w4 < -1) AS rule_4_1s, count(z) OVER w10 = 10 AND (min(z) OVER w10 > 0 OR max(z) OVER w10 < 0) AS rule_10x,
coalesce(count(step) OVER w6 = 6 AND min(step) OVER w6 = max(step) OVER w6 AND step <> 0, false) AS rule_7t
FROM g WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), w2 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 1 PRECEDING), w4 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 3 PRECEDING), w6 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 5 PRECEDING), w10 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 9 PRECEDING)""")
def control_chart(spark, sf_dir):
    chart = qaqc.control_chart(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    rules = ["rule_2_2s", "rule_r_4s", "rule_4_1s", "rule_10x", "rule_7t"]
    return chart.select("event_id", "status", *[F.coalesce(r, F.lit(False)).alias(r) for r in rules])


def _samples(spark, sf_dir) -> DataFrame:
    """All intervals of a hole: the first is the original, the others its duplicates of three types in turn."""
    n = F.col("n")
    suffix = F.when(n == 1, "").when(n % 3 == 2, "-DUP").when(n % 3 == 0, "-PD").otherwise("-CD")
    name = F.concat(F.lit("S"), F.col("hole").cast("string"), suffix)
    return _intervals(spark, sf_dir).select(F.struct("hole", "n").alias("row"), name.alias("sample_id"), F.col("l_extendedprice").alias("grade"))


_PAIRS = f"""{_LINES}, d AS (SELECT a.hole, b.n, CASE b.n % 3 WHEN 2 THEN 'field_duplicate' WHEN 0 THEN 'pulp_duplicate' ELSE 'core_duplicate' END AS kind,
a.l_extendedprice AS v, b.l_extendedprice AS w FROM i a JOIN i b ON a.hole = b.hole AND a.n = 1 AND b.n > 1)"""


@query(f"""WITH {_PAIRS}, r AS (SELECT *, v < 50000 AND w < 50000 AS low, CASE WHEN NOT (v < 50000 AND w < 50000) THEN abs(v - w) * 200 / (v + w) END AS rpd FROM d)
SELECT kind, count(*)::BIGINT AS pairs, count(*) FILTER (low)::BIGINT AS low_pairs, count(*) FILTER (rpd > 30)::BIGINT AS failed, round(avg(rpd), 4) AS mean_rpd, round(median(rpd), 4) AS median_rpd,
round(sqrt(sum(CASE WHEN NOT low THEN (v - w) * (v - w) END) / (2 * count(*) FILTER (NOT low))), 4) AS precision, round(avg(CASE WHEN NOT low THEN (v + w) / 2 END), 4) AS mean_value FROM r GROUP BY 1""")
def duplicate_precision(spark, sf_dir):
    return rounded(qaqc.duplicate_precision(qaqc.duplicate_pairs(_samples(spark, sf_dir), "sample_id", "grade", "row"), 10_000.0), 4)


@query("""SELECT CASE WHEN v > 200 THEN 'contaminated' WHEN v > 100 THEN 'elevated' ELSE 'clean' END AS status, count(*)::BIGINT AS n, round(avg(v), 6) AS mean_value, round(max(v), 6) AS max_value
FROM (SELECT CASE WHEN value < 0 THEN 10 ELSE value END AS v FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def blank_contamination(spark, sf_dir):
    return rounded(qaqc.blanks(read(spark, sf_dir, "events"), ["ts", "event_id"], "value", 20.0))


@query("""SELECT p_partkey, round(100 * (p_size / 40.304) / (p_size / 40.304 + p_retailprice / 100 / 71.844), 6) AS mg_number, round(p_retailprice / 10000, 6) AS wt_pct,
CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 30 THEN 'moderate' ELSE 'high' END AS band, round((p_retailprice / 101.961) / (p_size / 56.077), 6) AS acnk FROM part""")
def petrochemical_indices(spark, sf_dir):
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    none = F.lit(None).cast("double")
    return rounded(read(spark, sf_dir, "part").select("p_partkey", petrology.mg_number(s, r / 100).alias("mg_number"), petrology.convert_units(r, "ppm", "wt%").alias("wt_pct"), petrology.banded(s, [(10, "low"), (30, "moderate")], "high").alias("band"), petrology.acnk(r, s, none, none).alias("acnk")))


_SQUARE = [(10.5, 10.5), (40.5, 10.5), (40.5, 30.5), (10.5, 30.5)]


@query("""SELECT CASE WHEN p_partkey % 50 BETWEEN 11 AND 40 AND p_size BETWEEN 11 AND 30 THEN 'core' WHEN p_partkey % 50 < 5 AND p_size < 45 THEN 'edge' ELSE 'Unclassified' END AS polygon, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def polygon_classes(spark, sf_dir):
    df = read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    edge = [(-0.5, -0.5), (4.5, -0.5), (4.5, 44.5), (-0.5, 44.5)]
    return rounded(spatial.classify_points(df, "x", "y", [("core", _SQUARE), ("edge", edge)]).groupBy("polygon").agg(F.count("*").alias("n")))


@query("""WITH p AS (SELECT (p_partkey % 50)::DOUBLE x, p_size::DOUBLE y, p_retailprice v FROM part), b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p),
g AS (SELECT c AS col, r AS row, x0 + (x1 - x0) * c / 19 AS nx, y0 + (y1 - y0) * r / 19 AS ny FROM b, range(20) t1(c), range(20) t2(r)),
d AS (SELECT col, row, v, greatest((nx - x) * (nx - x) + (ny - y) * (ny - y), 1e-10) AS d2 FROM g, p WHERE (nx - x) * (nx - x) + (ny - y) * (ny - y) <= 25)
SELECT col::BIGINT AS col, row::BIGINT AS row, round(sum(v / power(d2, 0.75)) / sum(1 / power(d2, 0.75)), 4) AS z, count(*)::BIGINT AS n FROM d GROUP BY 1, 2""")
def idw_grid(spark, sf_dir):
    df = read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), "p_retailprice")
    return rounded(spatial.idw_grid(df, "x", "y", "p_retailprice", 20, 5.0), 4)


@query("""SELECT least(19, floor((l_extendedprice - lo) / (hi - lo) * 20))::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem, (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem) GROUP BY 1""")
def histogram(spark, sf_dir):
    return rounded(spatial.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 20))


@query("""SELECT (p_retailprice >= a)::BIGINT + (p_retailprice >= b)::BIGINT + (p_retailprice >= c)::BIGINT AS class, count(*)::BIGINT AS n FROM part, (SELECT quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.5) b, quantile_cont(p_retailprice, 0.75) c FROM part) GROUP BY 1""")
def quantile_classes(spark, sf_dir):
    return rounded(spatial.quantile_classes(read(spark, sf_dir, "part"), "p_retailprice", 4).groupBy("class").agg(F.count("*").alias("n")))


@query(None)
def representative_sample(spark, sf_dir):
    """A sampling operator: its size is the feature."""
    df = read(spark, sf_dir, "lineitem")
    return spatial.representative_sample(df, ["l_quantity", "l_extendedprice"], ALL_LINE, 10_000, "l_returnflag")


_BINS = f"""{_PAIRS}, k AS (SELECT (v + w) / 2 AS m, (v - w) * (v - w) AS d2, hole, n, count(*) OVER () AS many FROM d WHERE v + w > 0),
r AS (SELECT *, (row_number() OVER (ORDER BY m, d2, hole, n) - 1) // greatest(3, many // 6) AS bin FROM k WHERE many >= 6),
b AS (SELECT bin, min(m) AS low, max(m) AS high, avg(m) AS mean, sqrt(sum(d2) / (2 * count(*))) AS precision, count(*) AS pairs FROM r GROUP BY bin HAVING count(*) >= 2)"""


def _numbered_pairs(spark, sf_dir) -> DataFrame:
    pairs = qaqc.all_pairs(_samples(spark, sf_dir), "sample_id", value="grade").where("value is not null and value_dup is not null")
    return pairs.select("value", "value_dup", F.col("duplicate_row.hole").alias("hole"), F.col("duplicate_row.n").alias("n"))


@query(f"""WITH {_BINS} SELECT round(regr_slope(log10(precision), log10(mean)), 4) AS slope, round(regr_intercept(log10(precision), log10(mean)), 4) AS intercept,
round(regr_r2(log10(precision), log10(mean)), 4) AS r2, count(*)::BIGINT AS bins FROM b WHERE precision > 0""")
def thompson_howarth(spark, sf_dir):
    return rounded(qaqc.thompson_howarth(_numbered_pairs(spark, sf_dir), ["hole", "n"]), 4)


@query(f"WITH {_BINS} SELECT bin::BIGINT AS bin, round(low, 4) AS low, round(high, 4) AS high, round(mean, 4) AS mean, round(precision, 4) AS precision, pairs::BIGINT AS pairs FROM b")
def thompson_howarth_bins(spark, sf_dir):
    return rounded(qaqc.thompson_howarth_bins(_numbered_pairs(spark, sf_dir), ["hole", "n"]), 4)


@query(f"""WITH {_BINS}, f AS (SELECT regr_slope(log10(precision), log10(mean)) AS s, regr_intercept(log10(precision), log10(mean)) AS i FROM b WHERE precision > 0), x AS (SELECT power(10, 2 + k / 49.0 * 3) AS c FROM range(50) t(k))
SELECT round(c, 4) AS concentration, round(power(10, s * log10(c) + i), 4) AS precision FROM f, x""")
def thompson_howarth_curve(spark, sf_dir):
    fit = qaqc.thompson_howarth(_numbered_pairs(spark, sf_dir), ["hole", "n"])
    return rounded(qaqc.thompson_howarth_curve(fit, 100.0, 100_000.0), 4)


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity / 101.961 AS al, l_tax * 100 / 56.077 AS ca, l_discount * 100 / 61.979 AS na, l_linenumber / 94.196 AS k,
l_extendedprice / 1999.7 AS si, l_quantity AS alw, l_tax * 100 AS caw, l_discount * 100 AS naw FROM lineitem), w AS (SELECT *, least(ca, na) AS lime FROM m)
SELECT l_orderkey, l_linenumber, round(100 * al / nullif(al + lime + na, 0), 6) AS ciw,
round(CASE WHEN al >= k THEN 100 * (al - k) / nullif(al - k + lime + na, 0) END, 6) AS pia, round(al / nullif(na + k, 0), 6) AS ank,
round(2 * al / nullif(ca + 2 * na + 2 * k, 0), 6) AS asi, round((alw + l_linenumber) / nullif(caw + naw, 0), 6) AS vogt, round(si / alw, 6) AS ruxton,
round(100 * (2 * na / 0.35 + 2 * k / 0.25 + ca / 0.7), 6) AS wip FROM w""")
def weathering_indices(spark, sf_dir):
    al, ca, na, k, si = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_linenumber").cast("double"), F.col("l_extendedprice") / 1999.7
    zero = F.lit(0.0)
    found = {
        "ciw": petrology.ciw(al, ca, na), "pia": petrology.pia(al, ca, na, k), "ank": petrology.ank(al, na, k), "asi": petrology.asi(al, ca, na, k, zero),
        "vogt": petrology.vogt(al, k, zero, ca, na), "ruxton": petrology.ruxton_ratio(si, al), "wip": petrology.wip(na, zero, k, ca),
    }
    return rounded(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in found.items()]))


@query("""WITH s AS (SELECT avg(p_size) mx, avg(p_retailprice) my, var_samp(p_size) a, var_samp(p_retailprice) b, covar_samp(p_size, p_retailprice) c FROM part),
d AS (SELECT p_partkey, sqrt((b * (p_size - mx) ** 2 - 2 * c * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) ** 2) / (a * b - c * c)) AS d FROM part, s)
SELECT p_partkey, round(d, 5) AS distance, d > 2.0 AS is_anomaly FROM d""")
def mahalanobis(spark, sf_dir):
    found = multivariate.mahalanobis(read(spark, sf_dir, "part"), ["p_size", "p_retailprice"], 2.0)
    return rounded(found.select("p_partkey", "distance", "is_anomaly"), 5)


@query(None)
def pca_classes(spark, sf_dir):
    scored = multivariate.pca_scores(compose.clr(compose.replace_zeros(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *PARTS), PARTS), PARTS), [f"clr_{c}" for c in PARTS])
    return rounded(multivariate.classify_by_component(scored, "pc1", 0.1, "high").select("l_orderkey", "l_linenumber", "pc1", "pc2", "class"), 5)


@query(None)
def pca_loadings(spark, sf_dir):
    return rounded(multivariate.pca_loadings(read(spark, sf_dir, "lineitem"), PARTS), 5)
