"""Learners whose passes must hold little: folds without a kept copy of the table, distances a few at a time."""

import numpy as np
from pyspark.sql import functions as F

from corelode.operators import clusters, learning


def test_folds_keep_no_copy(spark):
    """While a fold is learned from, the rows dealt to folds are not kept; every row is in one fold."""
    rows = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 > 3, "b").otherwise("a").alias("y"), F.lit("wide").alias("more"))
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, seen = kept(), []

    def learn(part):
        seen.append((kept() - before, part.count()))
        return learning.fit_logistic(part, "y", learning.raw_features(["x"]), rounds=20)

    told = learning.cross_validated(rows, "y", ["id"], learn, 3).orderBy("fold").collect()
    assert [s[0] for s in seen] == [0, 0, 0] and sum(r.rows for r in told) == 3000
    assert [n for _, n in seen] == [3000 - r.rows for r in told] and all(r.accuracy == 1.0 for r in told)


def test_gradient_is_summed_by_tasks(spark):
    draw = np.random.default_rng(3)
    x, y, w = draw.normal(size=(500, 2)), draw.integers(0, 3, 500), draw.normal(size=(3, 3))
    rows = spark.createDataFrame([(int(c), *map(float, v)) for c, v in zip(y, x, strict=True)], "y int, x0 double, x1 double").repartition(7)
    full = np.c_[np.ones(500), x]
    p = np.exp(full @ w.T)
    want = (np.eye(3)[y] - p / p.sum(axis=1, keepdims=True)).T @ full
    assert np.allclose(learning._gradient(rows, w), want)
    assert not learning._gradient(rows.where("false"), w).any()


def test_silhouettes_hold_few_distances(spark, monkeypatch):
    """Distances of the asked rows are worked out a few at a time and no row passes through a second Python step."""
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(m, 0.2, (60, 2)) for m in (0, 3, 9)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double")
    monkeypatch.setattr(clusters, "CACHED", 700)
    fit = clusters.k_means(df, ["a", "b"], 3, restarts=2, rounds=20)
    table = clusters.silhouettes(df, fit, 50)
    assert "ArrowEvalPython" not in table._jdf.queryExecution().optimizedPlan().toString()
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own = np.sqrt(((x[:, None] - fit.centres[None]) ** 2).sum(axis=2)).argmin(axis=1)
    want = []
    for i, c in enumerate(own):
        a = away[i, own == c].sum() / ((own == c).sum() - 1)
        b = min(away[i, own == k].mean() for k in range(3) if k != c)
        want.append((a, b))
    got = [(r.a, r.b) for r in table.collect()]
    assert len(got) == 50 and all(np.isclose(want, g).all(axis=1).any() for g in got)
    none = clusters.silhouettes(df, clusters.Clusters(fit.columns, fit.names, fit.metric, fit.expressions, np.zeros((0, 2)), float("inf"), 0))
    assert none.count() == 0


def test_pairwise_either_way():
    draw = np.random.default_rng(5)
    a, b = draw.normal(size=(5, 3)), draw.normal(size=(900, 3))
    for metric, want in (("euclidean", np.sqrt(((a[:, None] - b) ** 2).sum(axis=2))), ("manhattan", np.abs(a[:, None] - b).sum(axis=2))):
        assert np.allclose(clusters._pairwise(a, b, metric), want) and (clusters._pairwise(b, a, metric) == clusters._pairwise(a, b, metric).T).all()
