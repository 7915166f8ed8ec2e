"""Operators on small tables: parts and brackets forced small, odd rows, constant columns."""

import numpy as np
from pyspark.sql import functions as F

from corelode.functions import calculations
from corelode.operators import compose, drill, frames, ordering, qaqc, spatial, stats, vectoring


def _numbers(spark, n=400, seed=1):
    draw = np.random.default_rng(seed)
    return spark.createDataFrame([(k, float(v), float(draw.integers(9))) for k, v in enumerate(draw.normal(size=n))], "k long, v double, w double")


def test_quantiles_by_brackets(spark, monkeypatch):
    df, shares = _numbers(spark), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    table = df.toPandas()
    for rows in (10, 5_000_000):
        monkeypatch.setattr(ordering, "EXACT_ROWS", rows)
        got = ordering.quantiles(df, {"a": "v", "b": "w"}, shares).first()
        assert np.allclose(got.a, table.v.quantile(shares)) and np.allclose(got.b, table.w.quantile(shares))


def test_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PART_ROWS", 50)
    df = _numbers(spark)
    got = ordering.average_ranks(ordering.ranked(df, "v", ["v"], "r"), "w", "a").toPandas()
    assert (got.r == got.v.rank(method="first")).all() and np.allclose(got.a, got.w.rank())


def test_one_collar_a_hole(spark):
    collar = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 1.0, 0.0, 0.0), ("b", 5.0, 6.0, 7.0)], "hole string, x double, y double, z double")
    survey = spark.createDataFrame([("a", 0.0, 0.0, -90.0), ("b", 10.0, 0.0, -90.0), ("c", 0.0, 0.0, -90.0)], "hole string, depth double, azimuth double, dip double")
    parts = spark.createDataFrame([("a", 0.0, 2.0), ("b", 2.0, 4.0), ("b", 90.0, 100.0), ("c", 1.0, 2.0)], "hole string, from double, to double")
    got = {(r.hole, r["from"]): (r.x, r.y, r.z) for r in drill.desurvey(collar, survey, parts).collect()}
    assert set(got) == {("b", 2.0), ("b", 90.0)} and np.allclose(got["b", 2.0], (5, 6, 4)) and np.allclose(got["b", 90.0], (5, 6, -3))


def test_constant_columns(spark):
    df = spark.range(5).select("id", F.lit(2.0).alias("x"), F.lit(3.0).alias("y"), F.lit(1.0).alias("v"))
    assert [(r.bin, r.n) for r in spatial.histogram(df, "x", 4).collect()] == [(0, 5)]
    assert [(r.col, r.row, r.n) for r in spatial.density_grid(df, "x", "y", 4).collect()] == [(0, 0, 5)]
    assert spatial.idw_grid(df, "x", "y", "v", 1, 1.0).first().z == 1.0
    assert qaqc.control_chart(df.withColumn("g", F.lit("s")).withColumn("v", F.lit(0.0)), "g", ["id"], "v").where("status <> 'pass'").count() == 0
    assert stats.anomaly_mad(df, "x").where("anomaly").count() == stats.anomaly_sigma(df, "x").where("anomaly").count() == 0


def test_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), (None, 1.0), (None, 5.0), (None, None)], "g string, v double")
    assert stats.anomaly_sigma(df, "v", 0.5, ["g"]).count() == 5 and qaqc.control_chart(df, "g", ["v"], "v").count() == 5


def test_zeros(spark):
    df = spark.createDataFrame([(1.0, 0.0, 3.0), (0.0, 0.0, 0.0), (None, 2.0, 2.0)], "a double, b double, c double")
    got = compose.replace_multiplicative(df, ["a", "b", "c"]).collect()
    assert np.allclose(got[0], (1 * (4 - 0.65) / 4, 0.65, 3 * (4 - 0.65) / 4)) and np.allclose(got[1], 0.001) and np.allclose(got[2], (1.3, 2 * 2.7 / 4, 2 * 2.7 / 4))
    assert compose.plr(df, ["a", "b"]).collect()[1].plr_a_b == 0.0 and compose.alr(df, ["a", "b"], "b").collect()[0].alr_a == 0.0


def test_frames(spark):
    df = spark.createDataFrame([(1, "x", None, " "), (2, "<5.5 ppm", None, None)], "id int, t string, gone double, blank string")
    assert frames.drop_empty_columns(df).columns == ["id", "t"] and frames.missing_columns(df, ["ID", "hole"]) == ["hole"]
    assert [r.t for r in frames.cast_column(df, "t", "numeric").orderBy("id").collect()] == [None, 5.5]
    assert frames.rename_to_standard(df, {"key": "id", "no": "nothing"}).columns[0] == "key"
    assert [r.gone for r in frames.zero_filled(df, ["gone"]).collect()] == [0.0, 0.0] and frames.negate(df, "id").agg(F.sum("id")).first()[0] == -3


def test_calculation_names(spark):
    df = spark.createDataFrame([(2.0, 4.0)], "cu_ppm double, Zn double")
    names = calculations.auto_mapping(df.columns, ["cu_zn"])
    assert names == {"Cu": "cu_ppm", "Zn": "Zn"} and calculations.calculate(df, ["cu_zn", "k_rb"], names).first()[2:] == (0.5, None)
    assert sum(calculations.category_counts().values()) == len(calculations.ALL)


def test_missing_elements():
    gone = vectoring.missing_elements({"Sr": "sr", "K": "k"})
    assert gone["sr-y"] == ["Y"] and set(gone) == set(vectoring.INDICATORS)


def test_fixed_bands(spark):
    """Bands held against literals: the SQL of their queries is made from the same tables."""
    cases = [
        ("sr-y", 19.9, "low"), ("sr-y", 20.0, "moderate"), ("sr-y", 40.0, "moderate"), ("sr-y", 40.1, "high"), ("sr-y", 100.0, "high"), ("sr-y", 100.1, "very-high"), ("kambalda-ratio", 1.0, "low"), ("kambalda-ratio", 1.01, "high"),
        ("k-rb", 9.0, "very-high"), ("k-rb", 201.0, "barren"), ("carlin-as", 500.0, "moderate"), ("carlin-as", 501.0, "high"), ("three-k-al", 0.3, "high"), ("three-k-al", 0.41, "moderate"), ("na-al", 0.2, "high"), ("sn-content", 4.0, "barren"),
        ("w-content", 201.0, "very-high"), ("u-se-relation", 5.0, "high"), ("mg-number", 50.0, None), ("ba-sr", 5.1, "low"),
    ]
    row = spark.range(1).select(*[vectoring.fertility(F.lit(v), i).alias(f"c{k}") for k, (i, v, _) in enumerate(cases)]).first()
    assert list(row) == [label for _, _, label in cases]
    assert vectoring.DEPOSITS["vms"] == ("eu-anomaly", "ba-sr", "alteration-index", "ccpi") and len(vectoring.DEPOSITS) == 18 and len(vectoring.INDICATORS) == 32


def test_deep_overlaps_find_the_pairs_of_a_hole(spark):
    draw = np.random.default_rng(5)
    left, right = [], []
    for k in range(400):
        a, b = (float(x) for x in draw.integers(0, 300, 2))
        left.append((f"h{k % 3}", k, a, a + float(draw.integers(-2, 9))))
        right.append((f"h{k % 4}", k, b, b + float(draw.choice([0, 1, 5, 40, 400])), "xyz"[k % 3]))
    left += [("h0", 900, None, 5.0), ("h0", 901, 5.0, None), (None, 902, 1.0, 2.0), ("lone", 903, 1.0, 2.0), ("h0", 904, 7.0, 7.0), ("h0", 905, 3.0, float("inf"))]
    right += [("h0", 900, 2.0, float("inf"), "x"), ("h0", 901, None, None, "y"), ("flat", 902, 4.0, 4.0, "z"), ("h0", 0, 1.0, 3.0, "x")]
    one = spark.createDataFrame(left, "hole string, row_id long, from double, to double")
    two = spark.createDataFrame(right, "hole string, log_id long, from double, to double, category string")
    pairs = lambda deep: sorted((r.row_id, r.log_id, r.r_from, r.pct) for r in drill.overlaps(one, two, deep=deep).where("pct < 1e300").collect())
    assert pairs(True) == pairs(False) and len(pairs(True)) > 1000
    assert drill.overlaps(one.limit(0), two, deep=True).count() == drill.overlaps(one, two.limit(0), deep=True).count() == 0


def test_brackets_of_small_groups(spark, monkeypatch):
    """Ranks between two rows of groups of any size, and groups without values, when the whole table is large."""
    monkeypatch.setattr(ordering, "EXACT_ROWS", 10)
    df = spark.createDataFrame([(g, float((k * 7) % (g + 1)) if g else None) for g in range(12) for k in range(g + 1)], "g long, v double")
    table, shares = df.toPandas(), [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r.q for r in ordering.quantiles(df, {"q": "v"}, shares, ["g"]).collect()}
    assert set(got) == set(range(12)) and got[0] is None
    for g in range(1, 12):
        assert np.allclose(got[g], table[table.g == g].v.quantile(shares)), g


def test_lines_deal_no_rows_by_group(spark, monkeypatch):
    """Rows meet the statistics of their group where they lie: no row is sent to a task of its group."""
    from corelode.operators import robust

    monkeypatch.setattr(ordering, "EXACT_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select(F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") * 3 % 17).cast("double").alias("y"))
        off = robust._off(rows, robust._lines(spark, {("g0",): (1.0, 0.0), ("g1",): (2.0, 1.0)}, rows.schema, ["g"]), ["g"])
        told = stats._with(off, ordering.quantiles(off, {"q": "r"}, [0.5], ["g"]), ["g"])
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
