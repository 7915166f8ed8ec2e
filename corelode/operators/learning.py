"""Trees, forests and multinomial logistic models: histograms and gradients are summed by Spark, models are small and stay on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.ordering import quantiles
from corelode.operators.stats import _with, class_scores

#: Fewer labelled rows are not learned from.
LEAST_ROWS = 10
#: Impurity and gain below which a node is a leaf.
PURE, LEAST_GAIN = 0.01, 0.001
#: Cells (nodes x features x bins x classes) that a task counts in one pass at most; a level of more takes several passes.
MOST_CELLS = 4_000_000


def ratio_features(columns: list[str], reference: str | None = None) -> dict[str, Column]:
    """Logarithms of ratios of all pairs, or against a reference; null where a part is not positive."""
    pairs = [(c, reference) for c in columns if c != reference] if reference else list(combinations(columns, 2))
    ok = lambda c: F.col(c).cast("double") > 0
    return {f"log({a}/{b})": F.when(ok(a) & ok(b), F.ln(F.col(a).cast("double") / F.col(b).cast("double"))) for a, b in pairs}


def raw_features(columns: list[str]) -> dict[str, Column]:
    """The columns as doubles; missing values and NaN count as 0."""
    return {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}


def chance(key: list[str], seed: int = 1) -> Column:
    """A number from 0 to 1 that the key and the seed decide."""
    return (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def with_folds(df: DataFrame, target: str, key: list[str], folds: int, seed: int = 1, name: str = "fold") -> DataFrame:
    """``df`` with a fold from 0: rows of each class are dealt by a hash of the key, in equal numbers but for one.

    The cuts are exact percentiles of the hash by class, so no class is sorted in one task.
    """
    drawn = df.withColumn("__u", chance(key, seed))
    cuts = quantiles(drawn, {"__cuts": "__u"}, [k / folds for k in range(1, folds)], [target]) if folds > 1 else None
    if cuts is None:
        return df.withColumn(name, F.lit(0))
    at = F.size(F.filter("__cuts", lambda b: F.col("__u") > b))
    return _with(drawn, cuts, [target]).withColumn(name, at).drop("__u", "__cuts")


def split(df: DataFrame, target: str, key: list[str], share: float = 0.7, seed: int = 1) -> DataFrame:
    """``df`` with ``train``: about ``share`` of each class, at least one row of it."""
    drawn = df.withColumn("__u", chance(key, seed))
    cut = quantiles(drawn, {"__cut": "__u"}, [share], [target])
    return _with(drawn, cut, [target]).withColumn("train", F.coalesce(F.col("__u") <= F.col("__cut")[0], F.lit(False))).drop("__u", "__cut")


@dataclass
class Node:
    """One node of a tree: its class counts, and for an inner node the feature and threshold (at most goes left)."""

    counts: dict[str, float]
    depth: int
    feature: int | None = None
    threshold: float | None = None

    @property
    def rows(self) -> float:
        return sum(self.counts.values())

    @property
    def impurity(self) -> float:
        n = self.rows
        return 1 - sum((c / n) ** 2 for c in self.counts.values()) if n else 0.0

    @property
    def prediction(self) -> str:
        return min(self.counts, key=lambda c: (-self.counts[c], c)) if self.counts else ""


@dataclass
class Forest:
    """Trees over named features: node 1 is a root, 2k and 2k + 1 are the children of k."""

    names: list[str]
    expressions: dict[str, Column]
    classes: list[str]
    trees: list[dict[int, Node]]
    seed: int
    key: list[str] = field(default_factory=list)

    def rules(self, tree: int = 0) -> list[str]:
        """One line a leaf, from left to right."""
        nodes, out = self.trees[tree], []

        def walk(k: int, path: list[str]) -> None:
            n = nodes[k]
            if n.feature is None:
                end = f'predict "{n.prediction}" (n={n.rows:g})'
                out.append(f"IF {' AND '.join(path)} THEN {end}" if path else end)
                return
            for child, sign in ((2 * k, "<="), (2 * k + 1, ">")):
                walk(child, [*path, f"{self.names[n.feature]} {sign} {n.threshold:.3f}"])

        if nodes:
            walk(1, [])
        return out

    def importance(self) -> list[tuple[str, float, float]]:
        """(feature, share, deviation) by falling share: impurity taken away, meant over the trees that use the feature."""
        gained: dict[str, list[float]] = {n: [] for n in self.names}
        for nodes in self.trees:
            own: dict[str, float] = {}
            for k, n in nodes.items():
                if n.feature is not None:
                    left, right = nodes[2 * k], nodes[2 * k + 1]
                    lost = n.impurity * n.rows - left.impurity * left.rows - right.impurity * right.rows
                    own[self.names[n.feature]] = own.get(self.names[n.feature], 0.0) + lost
            for name, value in own.items():
                gained[name].append(value)
        mean = {n: float(np.mean(v)) if v else 0.0 for n, v in gained.items()}
        total = sum(mean.values()) or 1.0
        spread = {n: float(np.std(v, ddof=1)) if len(v) > 1 else 0.0 for n, v in gained.items()}
        return sorted(((n, m / total, spread[n]) for n, m in mean.items()), key=lambda x: (-x[1], self.names.index(x[0])))

    def vote(self, df: DataFrame, name: str = "prediction", out_of_bag: bool = False) -> DataFrame:
        """``df`` with the class most trees take, the first of equals; out of bag only trees that did not learn from the row vote, null if all did."""
        trees, classes = [_arrays(t, self.classes) for t in self.trees], self.classes

        @F.pandas_udf("array<int>")
        def asked(rows):
            import pandas as pd

            x = np.array(rows.tolist(), float).reshape(len(rows), -1)
            return pd.Series(list(np.stack([_leaf(t, x) for t in trees], axis=1).astype(np.int32)))

        votes = asked(F.array(*[self.expressions[n] for n in self.names]))
        if out_of_bag:
            own = F.array(*[_draws(self.key, self.seed + t) for t in range(len(trees))])
            votes = F.filter(F.zip_with(votes, own, lambda v, w: F.when(w == 0, v)), lambda v: v.isNotNull())
        given = df.withColumn("__votes", votes)
        counts = F.transform(F.array(*map(F.lit, range(len(classes)))), lambda k: F.size(F.filter("__votes", lambda v: v == k)))
        best = F.element_at(F.array(*map(F.lit, classes)), F.array_position(counts, F.array_max(counts)).cast("int"))
        return given.withColumn(name, F.when(F.size("__votes") > 0, best)).drop("__votes")


def _arrays(nodes: dict[int, Node], classes: list[str]) -> tuple:
    place = {k: i for i, k in enumerate(sorted(nodes))}
    feature = np.array([-1 if nodes[k].feature is None else nodes[k].feature for k in sorted(nodes)])
    threshold = np.array([nodes[k].threshold or 0.0 for k in sorted(nodes)])
    left = np.array([place.get(2 * k, 0) for k in sorted(nodes)])
    right = np.array([place.get(2 * k + 1, 0) for k in sorted(nodes)])
    return feature, threshold, left, right, np.array([classes.index(nodes[k].prediction) for k in sorted(nodes)]), max(n.depth for n in nodes.values())


def _walked(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Place of the last node of each row; -1 for a row without the feature of a cut on its way."""
    feature, threshold, left, right, _, depth = tree
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = np.where(at < 0, -1, feature[at])
        value = x[np.arange(len(x)), np.maximum(f, 0)]
        with np.errstate(invalid="ignore"):
            down = np.where(np.isnan(value), -1, np.where(value <= threshold[at], left[at], right[at]))
        at = np.where(f < 0, at, down)
    return at


def _leaf(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, label, depth = tree
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = feature[at]
        value = x[np.arange(len(x)), np.maximum(f, 0)]
        with np.errstate(invalid="ignore"):
            down = np.where(value <= threshold[at], left[at], right[at])
        at = np.where(f < 0, at, down)
    return label[at]


def _draws(key: list[str], seed: int) -> Column:
    """How often a bootstrap takes a row: Poisson of mean 1, decided by its key."""
    u, below, out = chance(key, seed), 0.0, None
    for k in range(8):
        below += math.exp(-1) / math.factorial(k)
        out = F.when(u <= below, k) if out is None else out.when(u <= below, k)
    return out.otherwise(8)


def _bins(rows: DataFrame, size: int, most: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: all its values if there are few, else about equal numbers of rows."""
    v = [F.col("x")[k] for k in range(size)]
    many = rows.agg(*[F.approx_count_distinct(c, 0.02) for c in v]).first()
    shares = F.array(*[F.lit((k + 1) / most) for k in range(most)])
    told = [F.collect_set(c) if n <= 2 * most else F.percentile_approx(c, shares, F.lit(20 * most)) for c, n in zip(v, many, strict=True)]
    return [np.unique(np.array(b or [], float)) for b in rows.agg(*told).first()]


def _histograms(rows: DataFrame, opened: list[tuple[int, int]], trees: list[dict[int, Node]], classes: list[str], subsets: list[list[int]], ends: list[np.ndarray]) -> DataFrame:
    """(tree, node, f, b, y, n, low, high): rows of each open node by feature, bin and class, and the ends of what a bin holds.

    Rows stay where they lie: a task walks each down the trees so far and adds up its own, Spark adds up the tasks.
    """
    asked: dict[int, list[int]] = {}
    for t, k in opened:
        asked.setdefault(t, []).append(k)
    walks = {t: _arrays(trees[t], classes) for t in asked}
    slots = {t: np.array([ks.index(k) if k in ks else -1 for k in sorted(trees[t])]) for t, ks in asked.items()}
    bins, many = [len(e) + 1 for e in ends], len(classes)

    def told(batches):
        import pyarrow as pa

        held = {(t, f): (np.zeros(len(ks) * bins[f] * many, np.int64), np.full(len(ks) * bins[f], np.inf), np.full(len(ks) * bins[f], -np.inf)) for t, ks in asked.items() for f in subsets[t]}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(size, -1)
            w = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
            placed = [np.searchsorted(e, x[:, f]) for f, e in enumerate(ends)]
            for t in asked:
                at = _walked(walks[t], x)
                slot = np.where(at < 0, -1, slots[t][at])
                mine = np.flatnonzero((slot >= 0) & (w[:, t] > 0))
                for f in subsets[t]:
                    n, low, high = held[t, f]
                    own = mine[~np.isnan(x[mine, f])]
                    cell = slot[own] * bins[f] + placed[f][own]
                    n += np.bincount(cell * many + y[own], w[own, t], len(n)).astype(np.int64)
                    np.minimum.at(low, cell, x[own, f])
                    np.maximum.at(high, cell, x[own, f])
        for (t, f), (n, low, high) in held.items():
            full = np.flatnonzero(n)
            cell, label = full // many, full % many
            node = np.array(asked[t])[cell // bins[f]]
            columns = [np.full(len(full), t, np.int32), node, np.full(len(full), f, np.int32), (cell % bins[f]).astype(np.int32), label.astype(np.int32), n[full], low[cell], high[cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "f", "b", "y", "n", "low", "high"])

    return rows.mapInArrow(told, "tree int, node long, f int, b int, y int, n long, low double, high double")


def _best_splits(cells: DataFrame, opened: list[tuple[int, int]], trees: list[dict[int, Node]], least_leaf: int) -> dict[tuple[int, int], tuple]:
    """{(tree, node): (gain, feature, threshold, rows by class to the left, to the right)}: the best cut between neighbouring bins of each node."""
    counts = cells.groupBy("tree", "node", "f", "b", "y").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    table = counts.groupBy("tree", "node", "f").agg(F.collect_list(F.struct("b", "y", "n", "low", "high")).alias("cells"))

    # One call for each node and feature: its cells are at most bins x classes.
    @F.pandas_udf("struct<gain:double,threshold:double,labels:array<int>,left:array<double>,right:array<double>>")
    def searched(lists):
        import pandas as pd

        return pd.DataFrame([_cut(c, least_leaf) for c in lists], columns=["gain", "threshold", "labels", "left", "right"])

    impure = [(t, k, 1 - sum(c * c for c in trees[t][k].counts.values()) / trees[t][k].rows ** 2) for t, k in opened]
    total = F.broadcast(cells.sparkSession.createDataFrame(impure, "tree int, node long, impurity double"))
    found = table.withColumn("s", searched("cells")).where("s.threshold is not null").join(total, ["tree", "node"])
    found = found.select("tree", "node", "f", (F.col("impurity") + F.col("s.gain")).alias("gain"), "s.threshold", "s.labels", "s.left", "s.right")
    best = found.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("threshold")).alias("t"), "labels", "left", "right")).alias("best"))
    out = {}
    for r in best.collect():
        b = r["best"]
        out[r["tree"], r["node"]] = (b["gain"], -b["f"], -b["t"], dict(zip(b["labels"], b["left"], strict=True)), dict(zip(b["labels"], b["right"], strict=True)))
    return out


def _cut(cells, least_leaf: int) -> tuple:
    """(minus the weighted impurity of both sides, threshold, labels, their rows left and right of it) of the best cut, the lowest of equals."""
    bins, labels = sorted({c["b"] for c in cells}), sorted({c["y"] for c in cells})
    if len(bins) < 2:
        return None, None, None, None, None
    row, column = {b: i for i, b in enumerate(bins)}, {y: i for i, y in enumerate(labels)}
    n, low, high = np.zeros((len(bins), len(labels))), np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
    for c in cells:
        i = row[c["b"]]
        n[i, column[c["y"]]] += c["n"]
        low[i], high[i] = min(low[i], c["low"]), max(high[i], c["high"])
    left = n.cumsum(axis=0)[:-1]
    right = n.sum(axis=0) - left
    a, b = left.sum(axis=1), right.sum(axis=1)
    fit = (a >= least_leaf) & (b >= least_leaf)
    if not fit.any():
        return None, None, None, None, None
    with np.errstate(invalid="ignore", divide="ignore"):
        worth = -((a - (left**2).sum(axis=1) / a) + (b - (right**2).sum(axis=1) / b)) / (a + b)
        k = int(np.where(fit, worth, -np.inf).argmax())
        middle = (high[k] + low[k + 1]) / 2
    # Between neighbouring doubles the middle may round to the upper one.
    return float(worth[k]), float(middle if middle < low[k + 1] else high[k]), labels, left[k].tolist(), right[k].tolist()


def grow(
    df: DataFrame, target: str, expressions: dict[str, Column], key: list[str], trees: int = 1, max_depth: int = 10, least_leaf: int = 5, least_split: int = 10,
    share: float = 1.0, bootstrap: bool = False, bins: int = 256, seed: int = 1,
) -> Forest:
    """One tree of all rows, or a forest: each tree of a bootstrap (by hash of ``key``) and of a ``share`` of the features.

    All trees grow level by level.  A level sums one histogram (tree, node, feature, bin, class) and takes the best cut of
    every node by Gini impurity; a feature of up to ``bins`` values is cut exactly, midway between neighbouring
    values.  Leaves: depth, few rows, one class, impurity under 0.01, no cut with ``least_leaf`` rows a side and a gain of 0.001.  Rows without target are left
    out, rows without the feature of a cut leave the tree there; under 10 labelled rows no tree grows.
    """
    names = list(expressions)
    rows = df.where(F.col(target).isNotNull() & (F.col(target).cast("string") != "")).select(F.col(target).cast("string").alias("y"), F.array(*expressions.values()).alias("x"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)])
    keys = [f"__k{i}" for i in range(len(key))]
    draw = np.random.default_rng(seed)
    few = max(1, math.floor(len(names) * share))
    subsets = [sorted(draw.permutation(len(names))[:few].tolist()) if few < len(names) else list(range(len(names))) for _ in range(trees)]
    classes = sorted(r[0] for r in rows.select("y").distinct().collect())
    grown: list[dict[int, Node]] = [{} for _ in range(trees)]
    forest = Forest(names, expressions, classes, grown, seed, key)
    if rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
        forest.trees = []
        return forest
    ends = _bins(rows, len(names), bins)
    weights = F.array(*[(_draws(keys, seed + t) if bootstrap else F.lit(1)).cast("int") for t in range(trees)])
    label = (F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int")
    rows = rows.select(label.alias("y"), "x", weights.alias("w"))
    # Rows are read once a level, and dealt nowhere; all else is counts.
    roots = rows.groupBy("y").agg(F.array(*[F.sum(F.col("w")[t]) for t in range(trees)]).alias("n")).collect()
    fresh = {(t, 1): {r["y"]: r["n"][t] for r in roots} for t in range(trees)}
    cuts: dict[tuple[int, int], tuple[int, float]] = {}
    for depth in range(max_depth + 1):
        for (t, k), counts in fresh.items():
            if counts := {classes[y]: float(n) for y, n in counts.items() if n > 0}:
                grown[t][k] = Node(counts, depth)
        opened = [(t, k) for t, k in fresh if k in grown[t] and depth < max_depth and grown[t][k].rows >= least_split and len(grown[t][k].counts) > 1 and grown[t][k].impurity >= PURE]
        part = max(1, MOST_CELLS // (few * (max(map(len, ends)) + 1) * len(classes)))
        fresh = {}
        for s in range(0, len(opened), part):
            some = opened[s : s + part]
            for (t, k), (gain, f, threshold, left, right) in _best_splits(_histograms(rows, some, grown, classes, subsets, ends), some, grown, least_leaf).items():
                if gain >= LEAST_GAIN:
                    fresh |= {(t, 2 * k): left, (t, 2 * k + 1): right}
                    cuts[t, k] = (f, threshold)
        for (t, k), (f, threshold) in cuts.items():
            grown[t][k].feature, grown[t][k].threshold = f, threshold
        if not fresh:
            break
        cuts = {}
    return forest


@dataclass
class Logistic:
    """Classes by (intercept, features): weights over standardised features."""

    names: list[str]
    expressions: dict[str, Column]
    classes: list[str]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scores(self) -> list[Column]:
        return _scores([self.expressions[n] for n in self.names], self.centre, self.spread, self.weights)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the most probable class (the first of equals) and its probability."""
        scores = self.scores()
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        out = None
        for c, s in zip(self.classes, scores, strict=True):
            out = F.when(s >= best, c) if out is None else out.when(s >= best, c)
        total = sum((F.exp(s - best) for s in scores[1:]), F.exp(scores[0] - best))
        return df.withColumns({name: out, "probability": 1 / total})

    def importance(self) -> list[tuple[str, float]]:
        """(feature, share of the mean absolute weights) by falling share."""
        size = np.abs(self.weights[:, 1:]).mean(axis=0)
        share = size / size.sum() if size.sum() > 0 else size
        return sorted(zip(self.names, map(float, share), strict=True), key=lambda x: (-x[1], self.names.index(x[0])))


def _scores(x: list[Column], centre: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> list[Column]:
    scaled = [F.coalesce((c - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) if s > 0 else F.lit(0.0) for c, m, s in zip(x, centre, spread, strict=True)]
    return [sum((v * F.lit(float(b)) for v, b in zip(scaled, w[1:], strict=True)), F.lit(float(w[0]))) for w in weights]


def _gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Sum over all rows (class number, scaled features) of what the classes are off by times 1 and the features: a task adds up its rows, Spark adds up the tasks."""

    def told(batches):
        import pyarrow as pa

        sums = np.zeros(weights.shape)
        for batch in batches:
            size = batch.num_rows
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([np.ones(size), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            off = weights @ x
            off -= off.max(axis=0, initial=-np.inf)
            np.exp(off, out=off)
            off /= -off.sum(axis=0)
            off[y, np.arange(size)] += 1
            sums += off @ x.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["k", "v"])

    sums = np.zeros(weights.size)
    for k, v in rows.mapInArrow(told, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        sums[k] = v
    return sums.reshape(weights.shape)


def fit_logistic(df: DataFrame, target: str, expressions: dict[str, Column], rounds: int = 100, rate: float = 0.5, decay: float = 0.99) -> Logistic:
    """Multinomial logistic weights by gradients summed over all labelled rows, one pass a round.

    Features are standardised (missing ones count as the mean, those without spread as 0); a step is ``rate`` times the mean gradient, and the
    rate falls by ``decay``.  Classes are in the order of their names; no labelled rows give no classes.
    """
    names = list(expressions)
    rows = df.where(F.col(target).isNotNull() & (F.col(target).cast("string") != "")).select(F.col(target).cast("string").alias("y"), *[x.alias(f"x{k}") for k, x in enumerate(expressions.values())]).persist()
    try:
        x = [F.col(f"x{k}") for k in range(len(names))]
        told = rows.agg(F.count("*"), *[f(c) for c in x for f in (F.avg, F.stddev_samp)]).first()
        n = told[0]
        centre, spread = np.array([v or 0.0 for v in told[1::2]]), np.array([v or 0.0 for v in told[2::2]])
        classes = sorted(r[0] for r in rows.select("y").distinct().collect())
        weights = np.zeros((len(classes), len(names) + 1))
        scaled = [F.coalesce((c - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) if s > 0 else F.lit(0.0) for c, m, s in zip(x, centre, spread, strict=True)]
        told = rows.select((F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int").alias("y"), *[v.alias(f"x{k}") for k, v in enumerate(scaled)]) if classes else rows
        for _ in range(rounds if n and len(classes) > 1 else 0):
            weights = weights + rate * _gradient(told, weights) / n
            rate *= decay
        return Logistic(names, expressions, classes, centre, spread, weights)
    finally:
        rows.unpersist()


def score_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(average, precision, recall, f1, accuracy): means over classes, plain (macro) and weighted by rows."""
    s = class_scores(df, actual, predicted)
    hits = F.sum(F.col("recall") * F.col("support"))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    row = s.agg(
        F.struct(F.lit("macro").alias("average"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], (hits / F.sum("support")).alias("accuracy")).alias("a"),
        F.struct(F.lit("weighted").alias("average"), *[weighted(c).alias(c) for c in ("precision", "recall", "f1")], (hits / F.sum("support")).alias("accuracy")).alias("b"),
    )
    return row.select(F.inline(F.array("a", "b")))


def cross_validated(df: DataFrame, target: str, key: list[str], learn, folds: int = 5, seed: int = 1) -> DataFrame:
    """(fold, rows, accuracy): ``learn`` takes the rows of the other folds and gives a model with ``predict`` or ``vote``."""
    # The folds follow from the key and a few held cuts: they are dealt again in each pass, over the columns it reads, and not kept.
    dealt = with_folds(df.where(F.col(target).isNotNull()), target, key, folds, seed, "__fold")
    out = None
    for k in range(folds):
        model = learn(dealt.where(F.col("__fold") != k))
        kept = dealt.where(F.col("__fold") == k)
        told = (model.vote if isinstance(model, Forest) else model.predict)(kept, "__told")
        row = told.agg(F.lit(k).alias("fold"), F.count("*").alias("rows"), F.avg((F.col("__told") == F.col(target).cast("string")).cast("double")).alias("accuracy")).collect()
        part = df.sparkSession.createDataFrame(row, "fold int, rows long, accuracy double")
        out = part if out is None else out.union(part)
    return out
