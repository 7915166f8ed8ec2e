"""Clusters, populations, robust lines and learners beside numpy, with planted structure and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelode.operators import clusters, learning, ordering, populations, robust, stats


def _frame(spark, seed=0, n=300):
    draw = np.random.default_rng(seed)
    a, b = draw.normal(size=n) + np.repeat([0, 6, 12], n // 3), draw.normal(size=n) * 2 + np.repeat([5, 0, 9], n // 3)
    return spark.createDataFrame([(k, float(x), float(y), "abc"[3 * k // n]) for k, (x, y) in enumerate(zip(a, b, strict=True))], "id long, a double, b double, g string")


@pytest.mark.parametrize("metric", clusters.METRICS)
def test_distances(spark, metric):
    draw = np.random.default_rng(1)
    points, centre = draw.normal(size=(6, 4)), draw.normal(size=4)
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "p double, q double, r double, s double")
    got = [r[0] for r in df.select(clusters.distance([F.col(c) for c in df.columns], centre.tolist(), metric)).collect()]
    assert np.allclose(got, clusters._pairwise(points, centre[None, :], metric)[:, 0])
    zero = spark.createDataFrame([(0.0, 0.0)], "p double, q double")
    assert clusters._pairwise(np.zeros((1, 2)), np.ones((1, 2)), metric)[0, 0] == zero.select(clusters.distance([F.col("p"), F.col("q")], [1.0, 1.0], metric)).first()[0] == pytest.approx({"euclidean": math.sqrt(2), "logratio": math.sqrt(2), "manhattan": 2}.get(metric, 1))


def test_k_means(spark):
    df = _frame(spark).unionByName(spark.createDataFrame([(900, None, 1.0, "a"), (901, float("nan"), 1.0, "a")], "id long, a double, b double, g string"))
    fit = clusters.k_means(df, ["a", "b"], 3, restarts=4)
    got = fit.assign(df).toPandas()
    assert got.cluster[got.id >= 900].isna().all()
    got = got[got.id < 900]
    x = got[["a", "b"]].to_numpy()
    away = ((x[:, None] - fit.centres[None]) ** 2).sum(axis=2)
    assert (away.argmin(axis=1) == got.cluster).all() and np.allclose(away.min(axis=1).sum(), fit.inertia)
    assert np.allclose([x[got.cluster == c].mean(axis=0) for c in range(3)], fit.centres, atol=1e-6)
    assert got.groupby("g").cluster.agg(lambda s: s.value_counts(normalize=True).max()).min() > 0.9
    few = clusters.k_means(df.limit(2), ["a", "b"], 3)
    assert few.inertia == math.inf and few.assign(df.where("id < 2")).select("cluster").distinct().collect()[0][0] == 0
    table, best = clusters.elbow(df, ["a", "b"], range(1, 6), restarts=3)
    inertia = [r.inertia for r in table.orderBy("k").collect()]
    bends = [inertia[i - 1] - 2 * inertia[i] + inertia[i + 1] for i in range(1, 4)]
    assert best == 2 + int(np.argmax(bends))
    same = spark.createDataFrame([(1.0, 1.0)] * 5, "a double, b double")
    assert clusters.k_means(same, ["a", "b"], 2).inertia == 0


def test_silhouettes(spark):
    df = _frame(spark, 2, 90)
    fit = clusters.k_means(df, ["a", "b"], 3, restarts=2)
    got = fit.assign(df).toPandas()
    x, c = got[["a", "b"]].to_numpy(), got.cluster.to_numpy()
    away = clusters._pairwise(x, x, "euclidean")
    want = []
    for i in range(len(x)):
        a = away[i][(c == c[i]) & (np.arange(len(x)) != i)].mean()
        b = min(away[i][c == k].mean() for k in set(c) - {c[i]})
        want.append((b - a) / max(a, b))
    assert np.allclose(sorted(r.silhouette for r in clusters.silhouettes(df, fit, 1000).collect()), sorted(want))
    assert clusters.silhouettes(df, fit, 7).count() == 7


def test_transforms(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (0.0, 3.0, 3.0), (5.0, 5.0, 9.0)], "p double, q double, r double")
    x = np.maximum(np.array(df.collect()), 1e-10)
    told = lambda *a: np.array(df.select(*clusters.features(df, ["p", "q", "r"], *a).values()).collect())
    assert np.allclose(told("clr"), np.log(x) - np.log(x).mean(axis=1, keepdims=True)) and np.allclose(told("alr", "q"), np.log(x[:, [0, 2]] / x[:, [1]]))
    x = np.array(df.collect())
    assert np.allclose(told("zscore"), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1))


def _plain_mixture(v, size, rounds):
    s, n = np.sort(v), len(v)
    m, d, w = np.array([s[math.floor((k + 0.5) * n / size)] for k in range(size)]), np.full(size, v.std(ddof=1) / size), np.full(size, 1 / size)
    dense = lambda: w * np.exp(-0.5 * ((v[:, None] - m) / d) ** 2) / (d * math.sqrt(2 * math.pi))
    before = -math.inf
    for _ in range(rounds):
        p = dense()
        r = p / p.sum(axis=1, keepdims=True)
        held = r.sum(axis=0)
        m = (r * v[:, None]).sum(axis=0) / held
        d, w = np.sqrt(np.maximum((r * (v[:, None] - m) ** 2).sum(axis=0) / held, 1e-6)), held / n
        now = np.log(np.maximum(dense().sum(axis=1), 1e-300)).sum()
        if abs(now - before) < 1e-6:
            break
        before = now
    return m, d, w, now, r.argmax(axis=1)


def test_mixtures(spark):
    df = _frame(spark, 3)
    v = df.toPandas().a.to_numpy()
    n, fits = populations.fit_mixtures(df, "a", 3, rounds=40)
    for size, fit in enumerate(fits, 1):
        m, d, w, likelihood, _ = _plain_mixture(v, size, 40)
        assert np.allclose(fit.parts, np.stack([m, d, w], axis=1), atol=1e-6) and fit.likelihood == pytest.approx(likelihood)
    table, told = populations.populations(df, "a", 3, rounds=40)
    rows = table.orderBy("population").collect()
    assert [r.label for r in rows] == ["background", "anomalous", "high-grade"] and np.allclose([r["mean"] for r in rows], [0, 6, 12], atol=0.4)
    assert (told.toPandas().population == _plain_mixture(v, 3, 40)[4]).all()
    assert rows[0].separation == pytest.approx((rows[0]["mean"] * rows[1].deviation + rows[1]["mean"] * rows[0].deviation) / (rows[0].deviation + rows[1].deviation))


def test_mixtures_of_few_values(spark):
    constant = spark.range(30).select(F.lit(2.0).alias("v"))
    table, told = populations.populations(constant, "v", 3)
    assert table.count() <= 1 and told.count() == 30
    two = spark.range(60).select(F.when(F.col("id") % 3 == 0, 10.0).otherwise(1.0).alias("v"))
    rows = populations.populations(two, "v", 2, log=True)[0].orderBy("mean").collect()
    assert len(rows) == 2 and np.allclose([r["mean"] for r in rows], [1, 10], rtol=0.01) and [r.rows for r in rows] == [40, 20]
    short, told = populations.populations(two.limit(5), "v")
    assert short.count() == 0 and told.where("population is not null").count() == 0


def test_modes(spark):
    v = np.concatenate([np.random.default_rng(4).normal(0, 1, 400), np.random.default_rng(5).normal(9, 1, 200)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = populations.histogram_modes(df, "v", 30, 2).orderBy("mode").collect()
    assert len(got) == 2 and abs(got[0].centre) < 1 and abs(got[1].centre - 9) < 1
    assert populations.histogram_modes(df.limit(3), "v").count() == 0 and populations.histogram_modes(df.select(F.lit(1.0).alias("v")), "v").count() == 0


def _planted(spark):
    x = np.linspace(0, 10, 200)
    y = 3 * x + 2 + np.random.default_rng(6).normal(0, 3, 200)
    y[::8] += 60
    return x, y, spark.createDataFrame([(float(a), float(b), "u" if k % 2 else None) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, g string")


def _plain_reweighted(x, y, kind, rounds=50):
    b, a = np.polyfit(x, y, 1)
    for _ in range(rounds):
        r = y - b * x - a
        u = r / (1.4826 * np.median(np.abs(r - np.median(r))))
        w = np.where(np.abs(u) <= 1.345, 1, 1.345 / np.abs(u)) if kind == "huber" else np.where(np.abs(u) <= 4.685, (1 - (u / 4.685) ** 2) ** 2, 0)
        sw, mx, my = w.sum(), (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        slope = ((w * x * y).sum() - sw * mx * my) / ((w * x * x).sum() - sw * mx * mx)
        if abs(slope - b) < 1e-6 and abs(my - slope * mx - a) < 1e-6:
            break
        b, a = slope, my - slope * mx
    return b, a


@pytest.mark.parametrize("kind", ["huber", "bisquare"])
def test_reweighted(spark, kind):
    x, y, df = _planted(spark)
    got = robust.reweighted(df, "x", "y", kind).first()
    assert np.allclose((got.slope, got.intercept), _plain_reweighted(x, y, kind), atol=1e-5)
    assert abs(got.slope - 3) < 0.5
    parts = {r.g: r for r in robust.reweighted(df, "x", "y", kind, ["g"]).collect()}
    for g, k in (("u", 1), (None, 0)):
        assert np.allclose((parts[g].slope, parts[g].intercept), _plain_reweighted(x[k::2], y[k::2], kind), atol=1e-5)


def test_trimmed_line(spark):
    x, y, df = _planted(spark)
    got = robust.trimmed(df, "x", "y").first()
    assert abs(got.slope - 3) < 0.4 and abs(got.intercept - 2) < 2
    r2 = np.sort((y - got.slope * x - got.intercept) ** 2)[:150]
    assert got.trimmed_ss == pytest.approx(r2.sum(), rel=1e-6)


def test_lines_of_odd_tables(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "x double, y double")
    for df in (rows((1.0, 2.0)), rows((1.0, 2.0), (1.0, 4.0)), rows((1.0, 2.0), (2.0, 4.0), (None, 1.0), (float("nan"), 0.0))):
        for fit in (robust.reweighted(df, "x", "y"), robust.trimmed(df, "x", "y")):
            assert fit.count() == 1
        assert stats.regression_intervals(df, "x", "y").first().slope_low is None
    assert robust.reweighted(rows().limit(0), "x", "y", by=[]).count() <= 1
    flat = rows(*[(1.0, float(k)) for k in range(5)])
    assert stats.regression_intervals(flat, "x", "y").first().slope is None and robust.reweighted(flat, "x", "y").first().slope == 0


def test_trimmed_mahalanobis(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(200, 2)) @ np.array([[2, 1], [0, 1]])
    x[:10] += 40
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    near = np.argsort(d2(x.mean(axis=0), np.cov(x.T)))[:150]
    want = np.sqrt(d2(x[near].mean(axis=0), np.cov(x[near].T)))
    got = robust.trimmed_mahalanobis(df, ["a", "b"]).toPandas()
    assert np.allclose(np.sort(got.distance), np.sort(want), rtol=1e-6) and got.is_anomaly[got.a > 25].all()
    assert robust.trimmed_mahalanobis(df.limit(2), ["a", "b"]).where("is_anomaly or distance is not null").count() == 0


def test_correlations_without_spread(spark):
    df = spark.createDataFrame([(1.0, float(k), float(k * k), None if k else 1.0) for k in range(6)], "c double, x double, y double, z double")
    got = {(r.col_i, r.col_j): r for r in stats.correlation_p(df, ["c", "x", "y", "z"]).collect()}
    assert got["c", "x"].r == 0 and got["x", "z"].r == 0 and got["x", "z"].p == 1 and got["x", "y"].r == pytest.approx(np.corrcoef(range(6), [k * k for k in range(6)])[0, 1])
    assert stats.spearman(df, "c", "x").first().r == 0 and stats.spearman(df, "x", "y").first().r == pytest.approx(1)


def test_grouped_quantiles(spark, monkeypatch):
    df = _frame(spark, 8).unionByName(spark.createDataFrame([(-1, None, 1.0, "void"), (-2, 4.0, 1.0, None)], "id long, a double, b double, g string"))
    table = df.toPandas()
    for rows in (10, 5_000_000):
        monkeypatch.setattr(ordering, "EXACT_ROWS", rows)
        got = {r.g: r for r in ordering.quantiles(df, {"p": "a", "q": "b"}, [0.0, 0.3, 1.0], ["g"]).collect()}
        assert set(got) == {"a", "b", "c", "void", None} and not got["void"].p and got[None].p == [4.0] * 3
        for g in "abc":
            assert np.allclose(got[g].p, table[table.g == g].a.quantile([0, 0.3, 1])) and np.allclose(got[g].q, table[table.g == g].b.quantile([0, 0.3, 1]))


def _plain_tree(x, y, depth, least_leaf, least_split, level=0, node=1, out=None):
    out = {} if out is None else out
    labels, n = np.unique(y, return_counts=True)
    gini = lambda t: 1 - ((np.unique(t, return_counts=True)[1] / len(t)) ** 2).sum()
    out[node] = None
    if level >= depth or len(y) < least_split or len(labels) < 2 or gini(y) < 0.01:
        return out
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[1:] + v[:-1]) / 2:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) >= least_leaf:
                gain = gini(y) - left.mean() * gini(y[left]) - (~left).mean() * gini(y[~left])
                if gain > best[0] + 1e-12:
                    best = (gain, f, t)
    if best[0] < 0.001:
        return out
    out[node] = best[1:]
    left = x[:, best[1]] <= best[2]
    for k, part in ((0, left), (1, ~left)):
        _plain_tree(x[part], y[part], depth, least_leaf, least_split, level + 1, 2 * node + k, out)
    return out


def test_tree(spark):
    df = _frame(spark, 9)
    table = df.toPandas()
    fit = learning.grow(df, "g", learning.raw_features(["a", "b"]), ["id"], max_depth=4, bins=400)
    want = _plain_tree(table[["a", "b"]].to_numpy(), table.g.to_numpy(), 4, 5, 10)
    assert set(want) == set(fit.trees[0])
    for k, cut in want.items():
        n = fit.trees[0][k]
        assert (n.feature is None) == (cut is None) and (cut is None or (n.feature == cut[0] and n.threshold == pytest.approx(cut[1])))
    told = fit.vote(df).toPandas()
    assert (told.prediction == told.g).mean() > 0.95 and len(fit.rules()) == sum(c is None for c in want.values()) and sum(s for _, s, _ in fit.importance()) == pytest.approx(1)
    assert learning.grow(df.limit(5), "g", learning.raw_features(["a"]), ["id"]).trees == []


def test_forest(spark):
    df = _frame(spark, 10).withColumn("c", F.col("a") * 0 + 1)
    fit = learning.grow(df, "g", learning.raw_features(["a", "b", "c"]), ["id"], trees=7, share=0.7, bootstrap=True, max_depth=4)
    told = fit.vote(fit.vote(df, "all"), "bag", out_of_bag=True).toPandas()
    assert len(fit.trees) == 7 and (told["all"] == told.g).mean() > 0.9 and (told.bag.dropna() == told.g[told.bag.notna()]).mean() > 0.85 and told.bag.notna().mean() > 0.9
    assert dict((n, s) for n, s, _ in fit.importance())["c"] == 0


def test_logistic(spark):
    df = _frame(spark, 11)
    table = df.toPandas()
    fit = learning.fit_logistic(df, "g", learning.raw_features(["a", "b"]), rounds=25)
    x = table[["a", "b"]].to_numpy()
    x = np.hstack([np.ones((len(x), 1)), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)])
    y, w, rate = (table.g.to_numpy()[:, None] == np.array(["a", "b", "c"])).astype(float), np.zeros((3, 3)), 0.5
    for _ in range(25):
        p = np.exp(x @ w.T)
        w += rate * (y - p / p.sum(axis=1, keepdims=True)).T @ x / len(x)
        rate *= 0.99
    assert np.allclose(fit.weights, w, atol=1e-9)
    told = fit.predict(df)
    assert told.where("prediction = g").count() > 280 and told.where("probability between 0.3 and 1").count() == 300
    both = {r.average: r for r in learning.score_summary(told, "g", "prediction").collect()}
    assert both["macro"].accuracy == pytest.approx(both["weighted"].recall) and 0.9 < both["macro"].f1 <= 1


def test_folds(spark):
    df = _frame(spark, 12)
    sizes = {(r.g, r.fold): r["count"] for r in learning.with_folds(df, "g", ["id"], 5).groupBy("g", "fold").count().collect()}
    assert len(sizes) == 15 and set(sizes.values()) <= {19, 20, 21}
    assert {r.g: r.n for r in learning.split(df, "g", ["id"]).where("train").groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 70, "b": 70, "c": 70}
    got = learning.cross_validated(df, "g", ["id"], lambda rows: learning.fit_logistic(rows, "g", learning.raw_features(["a", "b"]), rounds=10), 3).collect()
    assert sum(r.rows for r in got) == 300 and min(r.accuracy for r in got) > 0.85


def test_ratio_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0)], "a double, b double, c double")
    got = df.select(*[x.alias(n) for n, x in learning.ratio_features(["a", "b", "c"]).items()]).first()
    assert got["log(a/b)"] == pytest.approx(math.log(0.5)) and got["log(a/c)"] is None and list(learning.ratio_features(["a", "b", "c"], "b")) == ["log(a/b)", "log(c/b)"]


def test_trees_in_several_passes(spark, monkeypatch):
    """A level of more cells than a task counts at once takes several passes, with the same trees; a cut lies under its upper bin."""
    df = _frame(spark, 12).withColumn("c", F.when(F.col("id") % 5 != 0, F.col("b")))
    grow = lambda: learning.grow(df, "g", {**learning.raw_features(["a"]), "c": F.col("c")}, ["id"], trees=2, bootstrap=True, max_depth=3)
    whole = grow().trees
    monkeypatch.setattr(learning, "MOST_CELLS", 1)
    assert grow().trees == whole and all(len(t) > 1 for t in whole)
    low = float(np.nextafter(1.0, 0.0))
    cells = [{"b": b, "y": b, "n": 9, "low": v, "high": v} for b, v in enumerate((low, 1.0))]
    assert learning._cut(cells, 5)[1] == low
