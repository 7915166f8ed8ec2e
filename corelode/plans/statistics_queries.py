"""Queries of vectoring and of the wider statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.operators import stats, vectoring
from corelode.plans.registry import query, read, rounded

PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ELEMENTS = sorted({e for i in vectoring.INDICATORS for e in vectoring.elements_of(i)})
COLUMNS = {e: e for e in ELEMENTS}


def _rocks(spark, sf_dir):
    key = F.col("p_partkey")
    made = [F.when((key + 5 * k) % 17 != 0, ((key * (k + 2)) % 83 + 1).cast("double") / (1 + k % 5)).alias(e) for k, e in enumerate(ELEMENTS)]
    return read(spark, sf_dir, "part").select("p_partkey", *made)


_ROCKS = "r AS (SELECT p_partkey, " + ", ".join(f'CASE WHEN (p_partkey + {5 * k}) % 17 <> 0 THEN ((p_partkey * {k + 2}) % 83 + 1)::DOUBLE / {1 + k % 5} END AS "{e}"' for k, e in enumerate(ELEMENTS)) + " FROM part)"
_FORMULAS = {
    "eu-anomaly": '("Eu" / 0.0563) / sqrt("Sm" / 0.148 * "Gd" / 0.199)', "kambalda-ratio": '("Ni" / "Cr") * ("Cu" / "Zn")', "sedex-metal-index": '"Zn" + 100 * "Pb" + coalesce(100 * "Tl", 0)',
    "sedex-alteration-index": '100 * ("Fe" + 10 * "Mn") / ("Fe" + 10 * "Mn" + "Mg")', "three-k-al": '3 * ("K" / 94.2) / ("Al" / 101.96)', "alteration-index": '100 * ("K" + "Mg") / ("K" + "Mg" + "Na" + "Ca")',
    "ccpi": '100 * ("Mg" + "Fe") / ("Mg" + "Fe" + "Na" + "K")', "mg-number": '100 * "Mg" / ("Mg" + "Fe")', "bi-te-signature": '"Bi" + "Te"', "k-rb": '"K" * 10000 / "Rb"', "u-se-relation": '"U" / "Se"', "u-mo-relation": '"U" / "Mo"',
} | {i: f'"{e}"' for i, e in vectoring.CONTENT.items()}


def _formula(i: str) -> str:
    return _FORMULAS.get(i) or '"{}" / "{}"'.format(*(e.capitalize() for e in i.split("-")))


def _label(i: str) -> str:
    out = "CASE WHEN v IS NULL THEN NULL"
    for sign, bound, name in vectoring.INDICATORS[i][1]:
        out += f" WHEN v BETWEEN {bound[0]} AND {bound[1]} THEN '{name}'" if sign == "between" else f" WHEN v {sign} {bound} THEN '{name}'"
    return out + " END" if "THEN '" in out else "NULL"


_CELLS = "c AS (" + " UNION ALL ".join(f"SELECT '{i}' AS indicator, v, {_label(i)} AS f FROM (SELECT {_formula(i)} AS v FROM r)" for i in vectoring.INDICATORS) + ")"
_SUMMARY = """s AS (SELECT indicator, count(v)::BIGINT AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, count(*) FILTER (f = 'barren')::BIGINT AS barren, count(*) FILTER (f = 'low')::BIGINT AS low,
count(*) FILTER (f = 'moderate')::BIGINT AS moderate, count(*) FILTER (f = 'high')::BIGINT AS high, count(*) FILTER (f = 'very-high')::BIGINT AS very_high FROM c GROUP BY 1)"""
_USES = "u(deposit, indicator, weight) AS (VALUES " + ", ".join(f"('{d}', '{i}', {2 if vectoring.INDICATORS[i][0] == 'fertility' else 1}::DOUBLE)" for d, names in vectoring.DEPOSITS.items() for i in names) + ")"


@query(f"WITH {_ROCKS}, {_CELLS}, {_SUMMARY} SELECT indicator, n, round(min, 5) AS min, round(max, 5) AS max, round(mean, 5) AS mean, round(std, 5) AS std, barren, low, moderate, high, very_high FROM s")
def vectoring_indicators(spark, sf_dir):
    return rounded(vectoring.indicator_summary(_rocks(spark, sf_dir), COLUMNS), 5)


@query(f"""WITH {_ROCKS}, {_CELLS}, {_SUMMARY}, {_USES} SELECT deposit, count(*)::BIGINT AS indicators, count(*) FILTER (high + very_high > 0.1 * n)::BIGINT AS positive,
round(sum(100.0 * (3 * very_high + 2 * high + moderate) / (3 * n) * weight) / sum(weight), 6) AS score FROM u JOIN s USING (indicator) GROUP BY 1""")
def deposit_ranking(spark, sf_dir):
    return rounded(vectoring.deposit_ranking(_rocks(spark, sf_dir), COLUMNS))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem),
f AS (SELECT l_returnflag, l_extendedprice < a OR l_extendedprice > b AS p, l_quantity > m + 1.5 * s AS u, l_tax > 0.07 AS t FROM lineitem, q)
SELECT l_returnflag, count(*) FILTER (p)::BIGINT AS percentile, count(*) FILTER (u)::BIGINT AS upper, count(*) FILTER (p OR u OR t)::BIGINT AS any, count(*) FILTER (p AND u AND t)::BIGINT AS every,
count(*) FILTER (p::INT + u::INT + t::INT > 1)::BIGINT AS most FROM f GROUP BY 1""")
def anomaly_combined(spark, sf_dir):
    rows = stats.anomaly_percentile(read(spark, sf_dir, "lineitem"), "l_extendedprice").withColumnRenamed("anomaly", "p")
    rows = stats.anomaly_upper(rows, "l_quantity", 1.5).withColumnRenamed("anomaly", "u").withColumn("t", F.col("l_tax") > 0.07)
    for mode, name in (("any", "any"), ("all", "every"), ("majority", "most")):
        rows = stats.combined(rows, ["p", "u", "t"], mode, name)
    hits = lambda c, name: F.count(F.when(F.col(c), 1)).alias(name)
    return rows.groupBy("l_returnflag").agg(hits("p", "percentile"), hits("u", "upper"), hits("any", "any"), hits("every", "every"), hits("most", "most"))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), r AS (SELECT l_returnflag, l_extendedprice - a - b * l_quantity AS e FROM lineitem, f),
m AS (SELECT median(e) AS m FROM r), d AS (SELECT median(abs(e - m)) AS d FROM r, m) SELECT l_returnflag, count(*) FILTER (abs(e - m) / (1.4826 * d) > 1.5)::BIGINT AS anomalies, round(max(abs(e - m) / (1.4826 * d)), 6) AS worst FROM r, m, d GROUP BY 1""")
def anomaly_regression(spark, sf_dir):
    found = stats.anomaly_regression(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1.5)
    return rounded(found.groupBy("l_returnflag").agg(F.count(F.when(F.col("anomaly"), 1)).alias("anomalies"), F.max("score").alias("worst")))


_FIT = "regr_{}(l_extendedprice, l_quantity)"
_SE = f"sqrt((1 - {_FIT.format('r2')}) * {_FIT.format('syy')} / ({_FIT.format('count')} - 2))"
_SE_S = f"{_SE} / sqrt({_FIT.format('sxx')})"
_SE_I = f"{_SE} * sqrt(1.0 / {_FIT.format('count')} + {_FIT.format('avgx')} ** 2 / {_FIT.format('sxx')})"


@query(f"""SELECT round({_FIT.format('slope')}, 5) AS slope, round({_FIT.format('slope')} - 1.96 * {_SE_S}, 5) AS slope_low, round({_FIT.format('slope')} + 1.96 * {_SE_S}, 5) AS slope_high,
round({_FIT.format('intercept')}, 5) AS intercept, round({_FIT.format('intercept')} - 1.96 * {_SE_I}, 5) AS intercept_low, round({_FIT.format('intercept')} + 1.96 * {_SE_I}, 5) AS intercept_high FROM lineitem""")
def regression_intervals(spark, sf_dir):
    return rounded(stats.regression_intervals(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 5)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c})::BIGINT AS n, round(exp(avg(CASE WHEN {c} > 0 THEN ln({c}) END)), 6) AS geometric_mean, round(100 * stddev_samp({c}) / abs(avg({c})), 6) AS cv, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem" for c in PARTS))
def summary_extended(spark, sf_dir):
    return rounded(stats.summary_extended(read(spark, sf_dir, "lineitem"), PARTS))


_TAIL = "(0.31938153 * k - 0.356563782 * k ** 2 + 1.781477937 * k ** 3 - 1.821255978 * k ** 4 + 1.330274429 * k ** 5)"


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, corr({a}, {b}) AS r, count(*) AS n FROM part" for a, b in (("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey"))) + f""")
, z AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS z FROM c), t AS (SELECT *, 1 / (1 + 0.2316419 * z) AS k FROM z)
SELECT col_i, col_j, round(r, 6) AS r, n::BIGINT AS n, round(CASE WHEN abs(r) >= 1 THEN 0 ELSE least(1, 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) * {_TAIL}) END, 6) AS p FROM t""")
def correlation_p(spark, sf_dir):
    return rounded(stats.correlation_p(read(spark, sf_dir, "part"), ["p_size", "p_retailprice", "p_partkey"]))


_CALLED = "CASE WHEN l_quantity > 30 THEN 'R' WHEN l_discount > 0.04 THEN 'N' ELSE 'A' END"


@query(f"""WITH t AS (SELECT l_returnflag AS a, {_CALLED} AS p FROM lineitem), k AS (SELECT a AS class FROM t UNION SELECT p FROM t), s AS (SELECT class, (SELECT count(*) FROM t WHERE a = class) AS support, (SELECT count(*) FROM t WHERE p = class) AS called, (SELECT count(*) FROM t WHERE a = class AND p = class) AS hit FROM k)
SELECT class, support::BIGINT AS support, round(coalesce(hit / called::DOUBLE, 0), 6) AS precision, round(coalesce(hit / support::DOUBLE, 0), 6) AS recall, round(2.0 * hit / (called + support), 6) AS f1 FROM s""")
def class_scores(spark, sf_dir):
    called = F.when(F.col("l_quantity") > 30, "R").when(F.col("l_discount") > 0.04, "N").otherwise("A")
    return rounded(stats.class_scores(read(spark, sf_dir, "lineitem").withColumn("called", called), "l_returnflag", "called"))


@query(f"SELECT l_returnflag AS actual, {_CALLED} AS predicted, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def cross_table(spark, sf_dir):
    called = F.when(F.col("l_quantity") > 30, "R").when(F.col("l_discount") > 0.04, "N").otherwise("A")
    return stats.cross_table(read(spark, sf_dir, "lineitem").withColumn("called", called), "l_returnflag", "called")


@query("""WITH g AS (SELECT l_linenumber, count(*) AS n, avg(l_quantity) AS a, avg(l_discount) AS b, var_pop(l_quantity) AS va, var_pop(l_discount) AS vb FROM lineitem GROUP BY 1), m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb FROM lineitem),
s AS (SELECT sum(n * (a - ma) ** 2 + n * (b - mb) ** 2) AS bss, sum(n * va + n * vb) AS wss FROM g, m) SELECT round(bss, 3) AS bss, round(wss, 3) AS wss, round(bss + wss, 3) AS tss, round(bss / (bss + wss), 3) AS ratio FROM s""")
def group_variation(spark, sf_dir):
    return rounded(stats.group_variation(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_linenumber"), 3)


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS name, count({c})::BIGINT AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem GROUP BY 1" for c in PARTS))
def cluster_statistics(spark, sf_dir):
    return rounded(stats.cluster_statistics(read(spark, sf_dir, "lineitem"), PARTS, "l_returnflag"))


@query("""WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi, count(*) AS n, 0.9 * least(stddev_samp(p_size), (quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25)) / 1.34) * power(count(*), -0.2) AS h FROM part),
x AS (SELECT i, lo - 0.1 * (hi - lo) + i * 1.2 * (hi - lo) / 199 AS x, h, n FROM b, range(200) t(i)) SELECT i::BIGINT AS i, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - p_size) / h) ** 2) / (h * sqrt(2 * pi()))) / n, 6) AS y FROM x, part GROUP BY i, x, n""")
def density_curve(spark, sf_dir):
    return rounded(stats.density_curve(read(spark, sf_dir, "part"), "p_size"))
