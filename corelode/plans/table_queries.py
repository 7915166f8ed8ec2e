"""Queries of table, composition and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.operators import compose, drill, frames, spatial
from corelode.plans.registry import query, read, rounded

PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEY = _KEY.split(", ")


def _texts(spark, sf_dir):
    q = F.col("l_quantity")
    k = F.pmod(F.col("l_partkey"), F.lit(9))
    text = F.when(k == 0, F.concat(F.lit("<"), q.cast("int").cast("string"))).when(k == 1, "N/A").when(k == 2, "-").when(k == 3, F.concat(F.lit("$1,"), (100 + q).cast("int").cast("string")))
    text = text.when(k == 4, F.concat(F.lit("-"), q.cast("int").cast("string"))).when(k == 5, "abc").when(k == 6, F.concat(q.cast("int").cast("string"), F.lit(" ppm"))).when(k == 7, "").otherwise(F.concat(q.cast("int").cast("string"), F.lit(".5")))
    return read(spark, sf_dir, "lineitem").select(k.alias("k"), text.alias("v"))


@query("""WITH t AS (SELECT l_partkey % 9 AS k, l_quantity::INT AS q FROM lineitem),
v AS (SELECT k, CASE k WHEN 0 THEN q WHEN 3 THEN 1100 + q WHEN 4 THEN 0 WHEN 6 THEN q WHEN 8 THEN q + 0.5 END AS v FROM t)
SELECT k::BIGINT AS k, count(*)::BIGINT AS rows, count(v)::BIGINT AS n, round(sum(v), 6)::DOUBLE AS total, sum(floor(v + 0.5))::BIGINT AS whole FROM v GROUP BY k""")
def cast_columns(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("w", F.col("v"))
    done = frames.cast_column(frames.cast_column(rows, "v", "numeric"), "w", "integer")
    return rounded(done.groupBy("k").agg(F.count("*").alias("rows"), F.count("v").alias("n"), F.sum("v").alias("total"), F.sum("w").alias("whole")))


@query("""SELECT rule, visible, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'low' WHEN l_quantity BETWEEN 10 AND 30 THEN 'mid' WHEN l_quantity BETWEEN 41 AND 50 THEN 'high' ELSE 'other' END AS rule,
NOT (l_quantity > 10 AND l_quantity <= 30) AND l_returnflag <> 'R' AS visible FROM lineitem) GROUP BY ALL""")
def attribute_rules(spark, sf_dir):
    rules = [{"name": "low", "min": 1, "max": 10}, {"name": "mid", "min": 10, "max": 30, "visible": False}, {"name": "high", "min": 41, "max": 50}]
    flags = [{"name": "a", "value": "A"}, {"name": "r", "value": "R", "visible": False}]
    rows = frames.rule_match(read(spark, sf_dir, "lineitem"), "l_quantity", rules, default="other")
    shown = frames.visible(rows, [("l_quantity", rules), ("l_returnflag", flags)])
    return shown.groupBy("rule", "visible").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_extendedprice), 4) AS total FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'N') GROUP BY 1""")
def value_filters(spark, sf_dir):
    rows = frames.value_filter(frames.value_filter(read(spark, sf_dir, "lineitem"), "l_quantity", 5, 40), "l_returnflag", values=["A", "N"])
    return rounded(rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total")), 4)


@query("""SELECT concat_ws(' + ', nullif(l_returnflag, 'N'), l_linestatus) AS class, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def crossed_classes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("f", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return frames.crossed(rows, ["f", "l_linestatus"], "class").groupBy("class").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN o_custkey % 5 = 0 THEN 'chosen' ELSE o_orderpriority END AS class, CASE WHEN o_custkey % 3 = 1 THEN 'late' WHEN o_custkey % 2 = 0 THEN 'early' END AS paint,
coalesce(CASE WHEN o_custkey % 3 = 1 THEN 'late' WHEN o_custkey % 2 = 0 THEN 'early' END, o_orderstatus) AS merged, count(*)::BIGINT AS n FROM orders GROUP BY ALL""")
def assigned_classes(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    key, c = "o_orderkey", F.col("o_custkey")
    early = rows.where(c % 2 == 0).select(key, F.lit(1).alias("seq"), F.lit("early").alias("group"))
    strokes = early.union(rows.where(c % 3 == 1).select(key, F.lit(2), F.lit("late")))
    done = frames.assign_class(rows, key, rows.where(c % 5 == 0), "o_orderpriority", "chosen").withColumnRenamed("o_orderpriority", "class")
    done = frames.merge_classes(frames.painted(done, key, strokes, "paint"), ["paint", "o_orderstatus"], "merged")
    return done.groupBy("class", "paint", "merged").agg(F.count("*").alias("n"))


@query("""SELECT least(3, greatest(0, (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 35)::INT))::BIGINT AS class, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def class_counts(spark, sf_dir):
    return rounded(frames.class_counts(read(spark, sf_dir, "lineitem"), "l_quantity", [5, 10, 20, 35, 45]))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(sum({c}), 4)::DOUBLE AS sum, count({c})::BIGINT AS n FROM lineitem" for c in PARTS))
def field_ranges(spark, sf_dir):
    return rounded(frames.field_ranges(read(spark, sf_dir, "lineitem"), PARTS).withColumn("sum", F.round("sum", 4)))


@query("SELECT l_returnflag AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def field_values(spark, sf_dir):
    return frames.field_values(read(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(log10(l_discount)), 6) AS mean FROM lineitem WHERE l_discount > 0 GROUP BY 1")
def log_positive(spark, sf_dir):
    return rounded(frames.log_positive(read(spark, sf_dir, "lineitem"), "l_discount", "v").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))


@query("""SELECT part, type, "limit", count(*)::BIGINT AS n FROM (SELECT unnest(['l_discount', 'l_tax']) AS part, unnest([CASE WHEN l_discount = 0 THEN 'below-dl' END, CASE WHEN l_linenumber = 2 THEN 'missing' WHEN l_tax = 0 THEN 'unknown' END]) AS type,
unnest([0.01::DOUBLE, NULL]) AS "limit" FROM lineitem) WHERE type IS NOT NULL GROUP BY ALL""")
def zero_classes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") != 2, F.col("l_tax")))
    return compose.classify_zeros(rows, KEY, ["l_discount", "l_tax"], {"l_discount": 0.01}).groupBy("part", "type", "limit").agg(F.count("*").alias("n"))


_GAPS = "(l_discount <= 0)::INT + (l_tax <= 0)::INT"
_LEAST = "least(l_quantity, l_extendedprice, CASE WHEN l_discount > 0 THEN l_discount ELSE 1e9 END, CASE WHEN l_tax > 0 THEN l_tax ELSE 1e9 END) * 0.65"
_SUM = "(l_quantity + l_extendedprice + l_discount + l_tax)"


@query(f"""WITH r AS (SELECT l_returnflag, l_discount, l_tax, {_GAPS} AS z, {_LEAST} AS d, {_SUM} AS s FROM lineitem), m AS (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN l_discount * (s - z * d) / s ELSE d END AS a, CASE WHEN l_tax > 0 THEN l_tax * (s - z * d) / s ELSE d END AS b FROM r)
SELECT l_returnflag, round(avg(a), 8) AS discount, round(avg(b), 8) AS tax FROM m GROUP BY 1""")
def multiplicative_zeros(spark, sf_dir):
    rows = compose.replace_multiplicative(read(spark, sf_dir, "lineitem"), PARTS)
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")), 8)


@query("""SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0 THEN l_discount ELSE 0.005 END), 8) AS discount, round(avg(CASE WHEN l_tax > 0 THEN l_tax ELSE (SELECT least(min(CASE WHEN l_tax > 0 THEN l_tax END), min(CASE WHEN l_discount > 0 THEN l_discount END)) / 2 FROM lineitem) END), 8) AS tax FROM lineitem GROUP BY 1""")
def limit_zeros(spark, sf_dir):
    rows = compose.replace_by_limit(read(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], {"l_discount": 0.01})
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")), 8)


@query("""SELECT l_returnflag, round(avg(exp((ln(l_quantity) + ln(l_extendedprice) + CASE WHEN l_discount > 0 THEN ln(l_discount) ELSE 0 END + CASE WHEN l_tax > 0 THEN ln(l_tax) ELSE 0 END) / (2 + (l_discount > 0)::INT + (l_tax > 0)::INT))), 6) AS g FROM lineitem GROUP BY 1""")
def geometric_means(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(compose.geometric_mean(PARTS)).alias("g")))


@query("""SELECT l_returnflag, round(avg(l_quantity / (l_quantity + l_extendedprice + l_linenumber)), 8) AS a, round(avg(l_linenumber / (l_quantity + l_extendedprice + l_linenumber)), 8) AS b FROM lineitem GROUP BY 1""")
def inverse_clr(spark, sf_dir):
    parts = ["l_quantity", "l_extendedprice", "l_linenumber"]
    rows = compose.inverse_clr(compose.clr(read(spark, sf_dir, "lineitem"), parts), [f"clr_{c}" for c in parts], ["a", "c", "b"])
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("a").alias("a"), F.avg("b").alias("b")), 8)


def _chi(c: str, p: float) -> str:
    ratio = f"({c} * t / (({_SUM}) * s_{c}))"
    return f"CASE WHEN {ratio} > 0 THEN ln({ratio}) ELSE 0 END" if p == 0 else f"CASE WHEN {ratio} > 0 THEN (power({ratio}, {p}) - 1) / {p} ELSE {-1 / p} END"


_SUMS = "(SELECT " + ", ".join(f"sum({c}) AS s_{c}" for c in PARTS) + f", sum({_SUM}) AS t FROM lineitem)"


@query("SELECT l_returnflag, " + ", ".join(f"round(avg({_chi(c, p)}), 6) AS {n}_{c}" for n, p in (("root", 0.25), ("log", 0)) for c in PARTS) + f" FROM lineitem, {_SUMS} GROUP BY 1")
def chi_power(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    both = compose.chi_power(rows, PARTS).withColumnsRenamed({f"chi_{c}": f"root_{c}" for c in PARTS})
    both = compose.chi_power(both, PARTS, 0).withColumnsRenamed({f"chi_{c}": f"log_{c}" for c in PARTS})
    return rounded(both.groupBy("l_returnflag").agg(*[F.avg(f"{n}_{c}").alias(f"{n}_{c}") for n in ("root", "log") for c in PARTS]))


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT {p} AS power, " + " + ".join(f"var_samp({_chi(c, p)})" for c in PARTS) + f" AS total FROM lineitem, {_SUMS}" for p in (0.1, 0.25, 0.33, 0.5, 0.75, 1.0)) + ") SELECT power::DOUBLE AS power, round(total, 5) AS total FROM p ORDER BY total DESC LIMIT 1")
def best_power(spark, sf_dir):
    return rounded(compose.best_power(read(spark, sf_dir, "lineitem"), PARTS), 5)


_WHOLE = "FROM lineitem WHERE l_discount > 0 AND l_tax > 0"


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{a}' AS part_i, '{b}' AS part_j, var_samp(ln({a} / {b})) AS variance {_WHOLE}" for k, a in enumerate(PARTS) for b in PARTS[k + 1 :]) + ") SELECT part_i, part_j, round(variance, 6) AS variance, round(100 * variance / (SELECT sum(variance) FROM v), 6) AS share FROM v")
def variance_shares(spark, sf_dir):
    return rounded(compose.variance_decomposition(read(spark, sf_dir, "lineitem"), PARTS))


@query("""SELECT l_returnflag, count(v)::BIGINT AS n, round(avg(v), 6) AS mean FROM (SELECT l_returnflag, CASE WHEN l_linenumber <> 3 THEN log10(l_quantity) + log10(CASE WHEN l_discount > 0 THEN l_discount ELSE m * 0.65 END) END AS v FROM lineitem, (SELECT min(CASE WHEN l_discount > 0 THEN l_discount END) AS m FROM lineitem)) GROUP BY 1""")
def log_additive(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    return rounded(compose.log_additive(rows, ["q", "l_discount"], "v").groupBy("l_returnflag").agg(F.count("v").alias("n"), F.avg("v").alias("mean")))


@query("SELECT l_returnflag, " + ", ".join(f"round(avg(CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) ELSE 0 END), 6) AS plr_{a}_{b}" for k, a in enumerate(PARTS) for b in PARTS[k + 1 :]) + " FROM lineitem GROUP BY 1")
def pairwise_ratios(spark, sf_dir):
    rows = compose.plr(read(spark, sf_dir, "lineitem"), PARTS)
    return rounded(rows.groupBy("l_returnflag").agg(*[F.avg(f"plr_{a}_{b}").alias(f"plr_{a}_{b}") for k, a in enumerate(PARTS) for b in PARTS[k + 1 :]]))


@query("""WITH i AS (SELECT l_orderkey AS hole, (7 * (l_linenumber - 1))::DOUBLE AS f, (7 * (l_linenumber - 1) + 9)::DOUBLE AS t, l_returnflag AS cat, row_number() OVER () AS k FROM lineitem),
p AS (SELECT a.hole, a.cat AS x, b.cat AS y FROM i a JOIN i b ON a.hole = b.hole AND (a.f, a.k) < (b.f, b.k) AND b.f < a.t)
SELECT hole, (SELECT count(*) FROM p q WHERE q.hole = c.hole)::BIGINT AS overlaps, string_agg(DISTINCT cat, '|' ORDER BY cat) AS categories FROM (SELECT hole, x AS cat FROM p UNION SELECT hole, y FROM p) c GROUP BY hole""")
def logging_overlaps(spark, sf_dir):
    start = (7 * (F.col("l_linenumber") - 1)).cast("double")
    logs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole"), start.alias("from"), (start + 9).alias("to"), F.col("l_returnflag").alias("category"))
    return rounded(drill.overlapping_logs(logs))


@query("SELECT o_orderkey AS hole FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def holes_missing(spark, sf_dir):
    hole = lambda t, c: read(spark, sf_dir, t).select(F.col(c).alias("hole"))
    return drill.holes_missing(hole("orders", "o_orderkey"), hole("lineitem", "l_orderkey"))


@query("""WITH b AS (SELECT min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part)
SELECT least(9, floor((p_size - x0) / (x1 - x0)::DOUBLE * 10))::BIGINT AS col, least(9, floor((p_retailprice - y0) / (y1 - y0) * 10))::BIGINT AS row, count(*)::BIGINT AS n, round(ln(1 + count(*)), 6) AS density FROM part, b GROUP BY 1, 2""")
def density_grid(spark, sf_dir):
    return rounded(spatial.density_grid(read(spark, sf_dir, "part"), "p_size", "p_retailprice", 10))


def _sample_sql(group: str, by_hole: bool = False) -> str:
    key = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    h = "('0x' || substr(md5({}), 1, 8))::BIGINT"
    pick = f"""s AS (SELECT g, count(*) AS n FROM o WHERE NOT odd GROUP BY 1), w AS (SELECT g, n, least(greatest(1, CASE WHEN abs(n * left_over::DOUBLE / rest % 1 - 0.5) < 1e-12 THEN 2 * round(n * left_over::DOUBLE / rest / 2) ELSE round(n * left_over::DOUBLE / rest) END), n) AS share FROM s, t),
c AS (SELECT o.*, row_number() OVER (PARTITION BY g ORDER BY h, {_KEY}) AS turn FROM o WHERE NOT odd), d AS (SELECT c.*, row_number() OVER (ORDER BY h, {_KEY}) AS place FROM c JOIN w USING (g) WHERE turn <= share),
e AS (SELECT d.* FROM d, t WHERE place <= left_over)"""
    if by_hole:
        pick = f"""s AS (SELECT g, count(*) AS n, {h.format('g::VARCHAR')} AS gh FROM o WHERE NOT odd GROUP BY 1), r AS (SELECT g, sum(n) OVER (ORDER BY gh, g) AS run, row_number() OVER (ORDER BY gh, g) AS turn FROM s),
e AS (SELECT o.* FROM o JOIN r USING (g), t WHERE NOT odd AND (run <= left_over OR turn = 1))"""
    return f"""WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b, quantile_cont(l_extendedprice, 0.25) AS c, quantile_cont(l_extendedprice, 0.75) AS d FROM lineitem),
o AS (SELECT {_KEY}, {group} AS g, l_quantity < a - 0.9 * (b - a) OR l_quantity > b + 0.9 * (b - a) OR l_extendedprice < c - 0.9 * (d - c) OR l_extendedprice > d + 0.9 * (d - c) AS odd, {h.format(key)} AS h FROM lineitem, q),
t AS (SELECT 10000 - count(*) FILTER (odd) AS left_over, count(*) FILTER (NOT odd) AS rest FROM o), {pick}
SELECT {_KEY}, odd AS outlier FROM o WHERE odd UNION ALL SELECT {_KEY}, odd FROM e"""


def _sample(spark, sf_dir, **more):
    found = spatial.representative_sample(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], KEY, 10_000, k=0.9, **more)
    return rounded(found.select(*KEY, "outlier"))


@query(_sample_sql("l_returnflag"))
def sample_by_class(spark, sf_dir):
    """A sampling operator: its size is the feature."""
    return _sample(spark, sf_dir, stratum="l_returnflag")


@query(_sample_sql("0"))
def sample_at_random(spark, sf_dir):
    return _sample(spark, sf_dir)


@query(_sample_sql("l_orderkey", True))
def sample_by_hole(spark, sf_dir):
    return _sample(spark, sf_dir, stratum="l_orderkey", by_hole=True)
