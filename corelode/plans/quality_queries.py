"""Queries of quality control over stand-in samples made from ``orders``, ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.operators import qaqc
from corelode.plans.registry import query, read, rounded

#: Sample ids of every form; {b} is the same number for 31 orders in a row, so that suffixes find their originals.
FORMS = (
    "S{b}", "S{b}-DUP", "s{b}_fd", "S{b}-A", "S{b}-B", "S{b}A", "S{b}B", "S{b}-PD", "S{b}_RPT", "S{b}-rep", "S{b}-CD", "S{b}-QC", "STD-OREAS-45e-001",
    "CRM_GBM301-12", "OREAS-24b", "Geostats-9", "SRM-88b", "REF_2", "MYSTANDARD1", "GBM301", "AMIS0044", "BLK-1", "blank2", "FB-01", "LB1", "MB_2",
    "X-BLANK", "DUP-7", "S{b}DUPLICATE", "PULPDUP{b}", "COREDUP{b}",
)
_N = len(FORMS)


def samples(spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (key % _N + 1).cast("int"))
    made = F.regexp_replace(form, r"\{b\}", F.floor(key / _N).cast("string"))
    pair = F.when(key % 5 == 0, F.concat(F.lit(" s"), F.floor(key / (2 * _N)).cast("string")))
    return read(spark, sf_dir, "orders").select(key.alias("row"), made.alias("id"), (F.col("o_totalprice") / 1000).alias("Au"), (F.col("o_custkey") % 97).cast("double").alias("Cu"), pair.alias("pair"))


_SAMPLES = (
    "s AS (SELECT o_orderkey AS row, replace([" + ", ".join(f"'{f}'" for f in FORMS) + f"][o_orderkey % {_N} + 1], '{{b}}', (o_orderkey // {_N})::VARCHAR) AS id, "
    f"o_totalprice / 1000 AS au, (o_custkey % 97)::DOUBLE AS cu, CASE WHEN o_orderkey % 5 = 0 THEN ' s' || (o_orderkey // {2 * _N}) END AS pair FROM orders)"
)
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(id, '{'|'.join(p)}', 'i') THEN '{k}'" for k, p in qaqc.QC_PATTERNS.items()) + " END"
_STANDARD = """upper(coalesce(nullif(regexp_extract(regexp_replace(id, '^(STD|CRM|SRM|REF)[-_]?', '', 'i'), '^([A-Za-z]+[-_]?[0-9]+[A-Za-z]?)', 1), ''), regexp_replace(id, '^(STD|CRM|SRM|REF)[-_]?', '', 'i')))"""
_BASES = {
    "field_duplicate": "CASE WHEN regexp_matches(id, '[-_](DUP|FD|A|B)$', 'i') THEN regexp_replace(id, '[-_](DUP|FD|A|B)$', '', 'i') WHEN regexp_matches(id, '[0-9][AB]$', 'i') THEN id[:-2] ELSE id END",
    "pulp_duplicate": "regexp_replace(id, '[-_](PD|RPT|REP)$', '', 'i')",
    "core_duplicate": "regexp_replace(id, '[-_](CD|QC)$', '', 'i')",
}


def _suffix_sql(kind: str) -> str:
    return f"""SELECT o.row AS original_row, d.row AS duplicate_row, o.id AS original_id, d.id AS duplicate_id, '{kind}' AS kind
FROM (SELECT *, {_BASES[kind]} AS base FROM s) d JOIN (SELECT base, coalesce(max(row) FILTER (id = base), min(row)) AS row FROM (SELECT *, {_BASES[kind]} AS base FROM s) GROUP BY base) k ON k.base = d.base
JOIN s o ON o.row = k.row WHERE d.id <> d.base AND o.row <> d.row"""


_LETTER = """SELECT a.row AS original_row, b.row AS duplicate_row, a.id AS original_id, b.id AS duplicate_id, 'field_duplicate' AS kind
FROM (SELECT upper(id[:-2]) AS base, max(row) AS row FROM s WHERE regexp_matches(id, '^.+([-_]|[0-9])A$', 'i') GROUP BY 1) k JOIN s a ON a.row = k.row
JOIN s b ON regexp_matches(b.id, '^.+([-_]|[0-9])B$', 'i') AND upper(b.id[:-2]) = k.base"""
_PAIRS = f"{_SAMPLES}, p AS ({' UNION '.join([*(_suffix_sql(k) for k in _BASES), _LETTER])})"


@query(f"WITH {_SAMPLES} SELECT row, {_TYPE} AS qc_type, CASE WHEN {_TYPE} = 'standard' THEN {_STANDARD} END AS standard_name FROM s")
def qc_samples(spark, sf_dir):
    return rounded(qaqc.detect(samples(spark, sf_dir), "id").select("row", "qc_type", "standard_name"))


@query(f"WITH {_SAMPLES}, k AS (SELECT {_TYPE} AS qc_type FROM s) SELECT coalesce(qc_type, 'overall') AS qc_type, count(*)::BIGINT AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 6) AS pct FROM k WHERE qc_type IS NOT NULL GROUP BY ROLLUP (qc_type)")
def qc_insertion_rate(spark, sf_dir):
    return rounded(qaqc.insertion_rate(samples(spark, sf_dir), "id"))


@query(f"WITH {_PAIRS} SELECT * FROM p")
def qc_pairs(spark, sf_dir):
    return rounded(qaqc.all_pairs(samples(spark, sf_dir), "id"))


@query(f"""WITH {_SAMPLES}, k AS (SELECT upper(id) AS key, max(row) AS row FROM s GROUP BY 1) SELECT o.row AS original_row, d.row AS duplicate_row, o.id AS original_id, d.id AS duplicate_id, 'field_duplicate' AS kind
FROM s d JOIN k ON upper(trim(d.pair)) = k.key JOIN s o ON o.row = k.row WHERE o.row <> d.row""")
def qc_column_pairs(spark, sf_dir):
    return rounded(qaqc.column_pairs(samples(spark, sf_dir), "id", "pair"))


@query(f"""WITH {_PAIRS}, d AS (SELECT kind, o.au AS a, b.au AS b FROM p JOIN s o ON o.row = original_row JOIN s b ON b.row = duplicate_row), e AS (SELECT *, a < 250 AND b < 250 AS low, abs(a - b) / ((a + b) / 2) AS share FROM d)
SELECT kind, count(*)::BIGINT AS pairs, count(*) FILTER (low)::BIGINT AS low_pairs, round(avg(share * 100), 6) AS rpd, round(avg(share * 50), 6) AS hard, round(100.0 * count(*) FILTER (share * 100 <= 30) / count(*), 6) AS within FROM e GROUP BY kind""")
def qc_duplicate_differences(spark, sf_dir):
    rows = samples(spark, sf_dir)
    told = qaqc.duplicate_differences(qaqc.with_values(qaqc.all_pairs(rows, "id"), rows, "Au"), 50.0)
    return rounded(told.groupBy("kind").agg(
        F.count("*").alias("pairs"), F.count(F.when(F.col("low"), 1)).alias("low_pairs"), F.avg("rpd").alias("rpd"), F.avg("hard").alias("hard"),
        (100 * F.avg((F.col("rpd") <= 30).cast("double"))).alias("within"),
    ))


_BATCH = "CASE WHEN regexp_matches(id, 'BATCH[-_]?[0-9]+', 'i') THEN 'BATCH' || regexp_extract(id, 'BATCH[-_]?([0-9]+)', 1, 'i') WHEN regexp_matches(id, '[-_]B[0-9]+$', 'i') THEN 'B' || regexp_extract(id, '[-_]B([0-9]+)$', 1, 'i') END"
_BATCHED = f"""b AS (SELECT row, CASE WHEN row % 11 = 0 THEN id || '_B' || (row % 7) WHEN row % 13 = 0 THEN 'BATCH-' || (row % 3) || id ELSE id END AS id FROM s),
c AS (SELECT row, id, {_BATCH} AS own FROM b), t AS (SELECT *, coalesce(own, 'AUTO_BATCH_' || ((row_number() OVER (PARTITION BY own IS NULL ORDER BY row) - 1) // 50 + 1)) AS batch FROM c)"""


@query(f"""WITH {_SAMPLES}, {_BATCHED} SELECT batch, count(*)::BIGINT AS n, count(*) FILTER ({_TYPE} = 'standard')::BIGINT AS standards, count(*) FILTER ({_TYPE} = 'blank')::BIGINT AS blanks,
count(*) FILTER ({_TYPE} LIKE '%duplicate')::BIGINT AS duplicates, round(100.0 * count({_TYPE}) / count(*), 6) AS insertion_pct FROM t GROUP BY batch""")
def qc_batches(spark, sf_dir):
    row, text = F.col("row"), F.col("id")
    named = F.when(row % 11 == 0, F.concat(text, F.lit("_B"), (row % 7).cast("string"))).when(row % 13 == 0, F.concat(F.lit("BATCH-"), (row % 3).cast("string"), text)).otherwise(text)
    return rounded(qaqc.batch_report(samples(spark, sf_dir).withColumn("id", named), "id"))


_CERTIFIED = {"click": (50.0, 4.0), "view": (48.0, 500.0)}


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, ts, event_id FROM events),
m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM v GROUP BY 1), c(event_type, certified, uncertainty) AS (VALUES ('click', 50.0::DOUBLE, 4.0::DOUBLE), ('view', 48.0, 500.0)),
l AS (SELECT event_type, coalesce(certified, mean) AS centre, CASE WHEN uncertainty > sd THEN uncertainty / 2 ELSE sd END AS sigma, mean, n FROM m LEFT JOIN c USING (event_type)),
q AS (SELECT *, CASE WHEN abs(value - centre) > 3 * sigma THEN 'fail' WHEN abs(value - centre) > 2 * sigma THEN 'warning' ELSE 'pass' END AS status FROM v JOIN l USING (event_type)),
r AS (SELECT *, CASE WHEN status = 'warning' THEN sign(value - centre) END AS side FROM q), t AS (SELECT *, coalesce(side = lag(side) OVER (PARTITION BY event_type ORDER BY k), false) AS same FROM r)
SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (status = 'pass')::BIGINT AS passed, count(*) FILTER (status = 'warning')::BIGINT AS warned, count(*) FILTER (status = 'fail')::BIGINT AS failed,
round(100.0 * count(*) FILTER (status <> 'fail') / count(*), 6) AS pass_pct, bool_or(same) AS bias, count(*) >= 5 AND abs(regr_slope(value, k) / avg(value)) * 100 > 2 AS drift FROM t GROUP BY event_type""")
def chart_summary(spark, sf_dir):
    certified = spark.createDataFrame([(k, *v) for k, v in _CERTIFIED.items()], "event_type string, certified double, uncertainty double")
    return rounded(qaqc.chart_summary(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", certified))


@query(f"""WITH {_SAMPLES}, b AS (SELECT row, id, au FROM s WHERE {_TYPE} = 'blank'), m AS (SELECT avg(au) AS m, stddev_samp(au) AS d FROM b)
SELECT b.row, b.id, round(b.au, 6) AS v, CASE WHEN b.au > m + 3 * d THEN 'contaminated' WHEN b.au > m + 2 * d THEN 'elevated' ELSE 'clean' END AS status, p.id AS preceding_id, round(p.au, 6) AS preceding_value,
coalesce(b.au > m + 3 * d AND p.au > 10 * b.au, false) AS event FROM b CROSS JOIN m LEFT JOIN s p ON p.row = b.row - 1""")
def blank_statistics(spark, sf_dir):
    return rounded(qaqc.contamination_events(samples(spark, sf_dir), "id", "Au", None))


@query(f"""WITH {_SAMPLES} SELECT b.row, b.id, round(b.au, 6) AS v, CASE WHEN b.au > 50 THEN 'contaminated' WHEN b.au > 25 THEN 'elevated' ELSE 'clean' END AS status, p.id AS preceding_id, round(p.au, 6) AS preceding_value,
coalesce(b.au > 50 AND p.au > 10 * b.au, false) AS event FROM (SELECT * FROM s WHERE {_TYPE} = 'blank') b LEFT JOIN s p ON p.row = b.row - 1""")
def blank_events(spark, sf_dir):
    return rounded(qaqc.contamination_events(samples(spark, sf_dir), "id", "Au", 5.0))


def _element_sql(e: str, limit: float) -> str:
    return f"""SELECT '{e}' AS element,
(SELECT 100.0 * count(*) FILTER (abs(x.{e} - y.m) <= 3 * CASE WHEN coalesce(y.d, 0) > 0 THEN y.d ELSE abs(y.m) * 0.05 END) / count(*) FROM t x JOIN (SELECT name, avg({e}) AS m, stddev_samp({e}) AS d FROM t WHERE kind = 'standard' GROUP BY name) y ON x.name = y.name WHERE x.kind = 'standard') AS sp,
(SELECT 100.0 * count(*) FILTER ({e} <= {5 * limit}) / count(*) FROM t WHERE kind = 'blank') AS bp,
(SELECT 100.0 * count(*) FILTER (coalesce(abs(o.{e} - b.{e}) / nullif((o.{e} + b.{e}) / 2, 0), 0) * 100 <= 30) / count(*) FROM p JOIN s o ON o.row = original_row JOIN s b ON b.row = duplicate_row WHERE NOT (o.{e} < {5 * limit} AND b.{e} < {5 * limit})) AS dp"""


@query(f"""WITH {_PAIRS}, t AS (SELECT *, {_TYPE} AS kind, {_STANDARD} AS name FROM s), e AS ({_element_sql('au', 30.0)} UNION ALL {_element_sql('cu', 8.0)}), g AS (SELECT *, 0.4 * sp + 0.35 * dp + 0.25 * bp AS score FROM e)
SELECT upper(element[1]) || element[2:] AS element, round(sp, 6) AS standard_pct, round(bp, 6) AS blank_pct, round(dp, 6) AS duplicate_pct, round(score, 6) AS score,
CASE WHEN score >= 95 THEN 'A' WHEN score >= 85 THEN 'B' WHEN score >= 75 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM g""")
def qc_element_summary(spark, sf_dir):
    return rounded(qaqc.element_summary(samples(spark, sf_dir), "id", ["Au", "Cu"], limits={"Au": 30.0, "Cu": 8.0}))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 100 AS r FROM orders) SELECT o_orderkey, round(greatest(0, CASE WHEN r % 3 = 0 THEN (0.35 * (100 - r) + 0.25 * r) / 0.6 - 5 WHEN r % 7 = 0 THEN r - 10 ELSE 0.4 * r + 0.35 * (100 - r) + 0.25 * r END), 6) AS score FROM k""")
def qc_scores(spark, sf_dir):
    """Scores with all types, without standards (every third rate), and with standards alone (every seventh)."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("double").alias("k"))
    k = F.col("k")
    standard = F.when(k % 3 != 0, k)
    blank, duplicate = F.when((k % 3 == 0) | (k % 7 != 0), k), F.when((k % 3 == 0) | (k % 7 != 0), 100 - k)
    return rounded(orders.select("o_orderkey", qaqc.qc_score(standard, blank, duplicate).alias("score")))
