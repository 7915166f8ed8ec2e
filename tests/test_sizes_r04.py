"""Holes whose rows are dealt once, and mixtures fitted in all their rounds."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corelode.operators import drill, populations
from corelode.plans import catalogue


def _rows(df):
    return sorted(map(str, df.collect()))


def test_deep_overlaps_deal_rows_once(spark, sf_dir):
    """The window's shuffle by hole is the only one: nothing is dealt by depth, and both sides read the same files."""
    found = catalogue.queries()["interval_overlap_deep"](spark, sf_dir)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ReusedExchange") == 1


def test_deep_matches_of_odd_rows(spark, monkeypatch):
    """As by the join of all pairs, also when a hole comes in several batches and its pairs are worked out a few at a time."""
    draw, inf, nan = np.random.default_rng(9), float("inf"), float("nan")
    left, right = [], []
    for k in range(300):
        a, b = (float(x) for x in draw.integers(0, 90, 2))
        left.append((f"h{k % 5}" if k % 30 else None, k // 2 if k % 17 else None, a, float(draw.choice([a - 1, a, a + 3, a + 20, inf, nan])), k))
        right.append((f"h{k % 6}" if k % 30 else None, int(draw.integers(0, 40)) if k % 13 else None, b, float(draw.choice([b - 2, b, b + 1, b + 9, 60.0, inf, nan])), "abcd"[k % 4] if k % 7 else None))
    left += [("h0", 900, None, 5.0, 1), ("h0", 901, 5.0, None, 2), ("lone", 902, 1.0, 2.0, 3), ("h1", 903, -inf, 9.0, 4), ("n", 904, 1.0, 2.0, 5), ("h9", 905, -inf, 5.0, 6)]
    right += [("h0", 1, None, 9.0, "a"), ("h1", 2, -inf, 4.0, "b"), ("n", 3, 0.0, 9.0, None), ("h0", 4, 3.0, None, "c"), ("h9", 5, -inf, 3.0, "d"), ("other", 6, 1.0, 2.0, "a")]
    one = spark.createDataFrame(left, "hole string, row_id long, from double, to double, more int")
    two = spark.createDataFrame(right, "hole string, log_id long, from double, to double, category string")
    want = _rows(drill.matched(one, two))
    assert _rows(drill.matched(one, two, deep=True)) == want and len(want) == len(left)
    monkeypatch.setattr(drill, "PAIRS_AT_ONCE", 7)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert _rows(drill.matched(one, two, deep=True)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    ints = one.where("not isnan(`to`) and `to` < 1e9 and `from` > -1e9").withColumns({c: F.col(c).cast("int") for c in ("from", "to")})
    assert _rows(drill.matched(ints, two, deep=True)) == _rows(drill.matched(ints, two)) and drill.matched(ints, two, deep=True).schema["from"].dataType.simpleString() == "int"
    assert drill.matched(one.limit(0), two, deep=True).count() == 0 and _rows(drill.matched(one, two.limit(0), deep=True)) == _rows(drill.matched(one, two.limit(0)))


def _plain_mixture(v, m, size, rounds):
    """Means, deviations, weights and the logarithm of the likelihood, from distinct values and their numbers."""
    n, upto = m.sum(), np.cumsum(m)
    middle = (m * v).sum() / n
    mean = np.array([v[np.searchsorted(upto, math.floor((k + 0.5) * n / size), side="right")] for k in range(size)])
    spread, weight = np.full(size, math.sqrt((m * (v - middle) ** 2).sum() / (n - 1)) / size), np.full(size, 1 / size)
    dense = lambda: weight * np.exp(-0.5 * ((v[:, None] - mean) / spread) ** 2) / (spread * math.sqrt(2 * math.pi))
    before = -math.inf
    for _ in range(rounds):
        share = m[:, None] * dense() / dense().sum(axis=1, keepdims=True)
        held = share.sum(axis=0)
        mean = (share * v[:, None]).sum(axis=0) / held
        spread, weight = np.sqrt((share * (v[:, None] - mean) ** 2).sum(axis=0) / held), held / n
        now = (m * np.log(dense().sum(axis=1))).sum()
        if abs(now - before) < 1e-6:
            break
        before = now
    return mean, spread, weight, now


def test_population_mixture_takes_all_rounds(spark, sf_dir):
    """The query's components are those of up to 100 rounds, not of the first few."""
    v, m = np.unique(pd.read_parquet(f"{sf_dir}/lineitem.parquet").l_quantity, return_counts=True)
    fits = [_plain_mixture(v, m, size, 100) for size in (1, 2, 3)]
    best = min(fits, key=lambda x: math.log(m.sum()) * (3 * len(x[0]) - 1) - 2 * x[3])
    got = catalogue.queries()["population_mixture"](spark, sf_dir).orderBy("population").toPandas()
    assert np.allclose(got[["mean", "deviation", "proportion"]], np.stack(best[:3], axis=1), atol=2e-5)
    early = _plain_mixture(v, m, len(best[0]), 4)
    assert np.abs(early[0] - best[0]).max() > 0.1


def test_rounds_in_several_tasks(spark, monkeypatch):
    """The same mixture whether its distinct values lie in one task or in many, and nothing stays kept."""
    draw = np.random.default_rng(11)
    values = np.round(np.concatenate([draw.normal(0, 1, 400), draw.normal(6, 2, 300)]), 2)
    df = spark.createDataFrame([(float(x),) for x in values], "v double")
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    one = populations.fit_mixtures(df, "v", 2)[1]
    monkeypatch.setattr(populations, "VALUES_A_TASK", 50)
    many = populations.fit_mixtures(df, "v", 2)[1]
    assert all(np.allclose(a.parts, b.parts, rtol=1e-9) for a, b in zip(one, many, strict=True))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
