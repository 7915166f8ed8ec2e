"""k-means over numeric columns: rounds of one aggregation, whose result (restarts x classes x columns) alone reaches the driver."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete

METRICS = ("euclidean", "manhattan", "correlation", "cosine", "logratio")
TRANSFORMS = ("none", "clr", "alr", "zscore")
#: What a part counts at least before its logarithm is taken.
LEAST_PART = 1e-10
#: Distances that a task of silhouettes works out at once.
CACHED = 1 << 15


def features(df: DataFrame, columns: list[str], transform: str = "none", reference: str | None = None) -> dict[str, Column]:
    """Columns ``f_...`` to measure distances by, for rows whose columns are finite.

    ``clr`` and ``alr`` take logarithms of parts (LEAST_PART at least) against their mean or a reference part; ``zscore`` takes sample
    deviations from the mean, 0 for a column without spread.  Only ``zscore`` reads the table.
    """
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {transform}")
    v = {c: F.col(c).cast("double") for c in columns}
    if transform == "none":
        return {f"f_{c}": x for c, x in v.items()}
    if transform == "zscore":
        row = complete(df, columns).agg(*[f(x) for x in v.values() for f in (F.avg, F.stddev_samp)]).first()
        centre = {c: (row[2 * k] or 0.0, row[2 * k + 1] or 0.0) for k, c in enumerate(columns)}
        return {f"f_{c}": (x - F.lit(centre[c][0])) / F.lit(centre[c][1]) if centre[c][1] > 0 else F.lit(0.0) for c, x in v.items()}
    logs = {c: F.ln(F.greatest(x, F.lit(LEAST_PART))) for c, x in v.items()}
    if transform == "alr":
        if reference not in columns:
            raise ValueError("alr takes one of the columns as its reference")
        return {f"f_{c}": x - logs[reference] for c, x in logs.items() if c != reference}
    mean = reduce(add, logs.values()) / len(logs)
    return {f"f_{c}": x - mean for c, x in logs.items()}


def distance(point: list[Column], centre: list[float], metric: str) -> Column:
    """Distance of a row from a centre; ``logratio`` is the Euclidean one of log-ratios.  A vector without length or spread has similarity 0."""
    at = [F.lit(float(c)) for c in centre]
    if metric in ("euclidean", "logratio"):
        return F.sqrt(reduce(add, [(x - c) * (x - c) for x, c in zip(point, at, strict=True)]))
    if metric == "manhattan":
        return reduce(add, [F.abs(x - c) for x, c in zip(point, at, strict=True)])
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric == "correlation":
        mean, middle = reduce(add, point) / len(point), float(np.mean(centre))
        point, centre = [x - mean for x in point], [c - middle for c in centre]
    dot = reduce(add, [x * F.lit(float(c)) for x, c in zip(point, centre, strict=True)])
    length = reduce(add, [x * x for x in point]) * F.lit(float(np.dot(centre, centre)))
    return F.lit(1.0) - F.when(length > 0, dot / F.sqrt(length)).otherwise(0.0)


def _block(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]).T


@dataclass
class Clusters:
    """Fitted centres (classes by features), their inertia and the rounds of the best restart."""

    columns: list[str]
    names: list[str]
    metric: str
    expressions: dict[str, Column]
    centres: np.ndarray
    inertia: float
    rounds: int

    def assign(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """``df`` with the class of each row and its distance; null where a column is not finite, 0 for too few rows to fit."""
        v = [F.col(c).cast("double") for c in self.columns]
        known = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in v])
        if not len(self.centres):
            return df.withColumns({name: F.when(known, F.lit(0)), "distance": F.lit(None).cast("double")})
        centres, metric = self.centres, self.metric

        @F.pandas_udf("struct<c:int,d:double>")
        def nearest(*columns):
            import pandas as pd

            away = _pairwise(np.stack([c.to_numpy(float) for c in columns], axis=1), centres, metric)
            with np.errstate(invalid="ignore"):
                return pd.DataFrame({"c": away.argmin(axis=1), "d": away.min(axis=1)})

        told = df.withColumn("__near", nearest(*self.expressions.values()))
        return told.withColumns({name: F.when(known, F.col("__near.c")), "distance": F.when(known, F.col("__near.d"))}).drop("__near")


def _drawn(block: np.ndarray, seed: int, restart: int, turn: int) -> np.ndarray:
    """Minus the logarithm of a number from 0 to 1 that a row's features decide."""
    # Multipliers and shifts of a 64-bit mixing hash.
    key = np.full(len(block), (seed * 1_000_003 + restart * 1009 + turn) & 0xFFFFFFFF, np.uint64)
    for column in np.ascontiguousarray(block.T + 0.0).view(np.uint64):
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(27)
        key *= np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    return -np.log(((key >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53))


def _seeds(rows: DataFrame, names: list[str], k: int, metric: str, restarts: int, seed: int) -> list[np.ndarray]:
    """Starting centres of each restart: rows drawn in proportion to the square of their distance from the centres before.

    Draws are races (least of -ln u over weight), so each takes one pass for all restarts; a task tells its winners.
    """
    chosen: list[list[tuple]] = [[] for _ in range(restarts)]
    fields = ", ".join(["r int", "away boolean", "race double", *[f"`{c}` double" for c in names]])
    for turn in range(k):
        before = [np.array(c, float) for c in chosen]

        def winners(batches, before=before, turn=turn):
            import pyarrow as pa

            best: dict[int, tuple] = {}
            for batch in batches:
                block = _block(batch, names)
                for r, centres in enumerate(before):
                    race = _drawn(block, seed, r, turn)
                    least = _pairwise(block, centres, metric).min(axis=1) if turn else np.ones(len(block))
                    # Where no row is away from the centres, any row is as good.
                    away = least > 0
                    if away.any():
                        race = np.where(away, race / np.where(away, least, 1.0) ** 2, np.inf)
                    if len(block):
                        i = int(race.argmin())
                        best[r] = min(best.get(r, (False, np.inf)), (bool(away[i]), float(race[i]), *block[i].tolist()), key=lambda x: (not x[0], x[1]))
            if best:
                told = [(r, *b) for r, b in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*told, strict=True)], names=["r", "away", "race", *names]).cast(
                    pa.schema([("r", pa.int32()), ("away", pa.bool_()), ("race", pa.float64()), *[(c, pa.float64()) for c in names]])
                )

        found = rows.mapInArrow(winners, fields).groupBy("r").agg(F.min_by(F.struct(*names), F.struct(~F.col("away"), "race", *names))).collect()
        for r, point in found:
            chosen[r].append(tuple(point))
    return [np.array(c, float) for c in chosen]


def _summed(rows: DataFrame, names: list[str], centres: dict[int, np.ndarray], metric: str) -> list:
    """(restart, class, rows, sum of squared distances, sums of features) of the nearest centres of each restart, the first of equals."""
    fields = ", ".join(["r int", "c int", "n long", "d2 double", *[f"`{c}` double" for c in names]])

    def told(batches):
        import pyarrow as pa

        size = {r: len(c) for r, c in centres.items()}
        sums = {r: np.zeros((k, len(names) + 2)) for r, k in size.items()}
        for batch in batches:
            block = _block(batch, names)
            for r, at in centres.items():
                away = _pairwise(block, at, metric)
                cluster = away.argmin(axis=1)
                least = away[np.arange(len(block)), cluster]
                for j, weight in enumerate([None, least * least, *block.T]):
                    sums[r][:, j] += np.bincount(cluster, weight, size[r])
        out = [(r, c, int(v[0]), *v[1:].tolist()) for r, s in sums.items() for c, v in enumerate(s) if v[0]]
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * (len(names) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["r", "c", "n", "d2", *names])

    return rows.mapInArrow(told, fields).groupBy("r", "c").agg(F.sum("n"), F.sum("d2"), *[F.sum(c) for c in names]).collect()


def _class_means(df: DataFrame, expressions: dict[str, Column], start: Column, columns: list[str]) -> list[np.ndarray]:
    rows = complete(df, columns).select(start.alias("__s"), *[x.alias(c) for c, x in expressions.items()]).where("__s is not null")
    means = rows.groupBy("__s").agg(*[F.avg(c) for c in expressions]).orderBy("__s").collect()
    return [np.array([[float(x) for x in r[1:]] for r in means])]


def k_means(
    df: DataFrame, columns: list[str], k: int, metric: str = "euclidean", transform: str = "none", reference: str | None = None,
    restarts: int = 10, rounds: int = 100, tolerance: float = 1e-6, seed: int = 1, start: Column | None = None,
) -> Clusters:
    """``k`` classes of the complete rows; of all restarts the one with the least sum of squared distances.

    A round assigns rows and sums them by class for all restarts that still move, in one pass: a task adds up its rows, Spark adds up the tasks.  A class without
    rows keeps its centre.  A restart ends when its sum changes by less than ``tolerance``; centres that belong to that sum are kept.
    ``start`` takes the means of existing classes (in their order; ``k`` is then their number) in place of drawn rows.
    Fewer complete rows than classes give no centres.
    """
    expressions = features(df, columns, transform, reference)
    names = list(expressions)
    fitted = lambda c, inertia, n: Clusters(columns, names, metric, expressions, c, inertia, n)
    rows = complete(df, columns).select(*[x.alias(c) for c, x in expressions.items()]).persist()
    try:
        if k < 1 or rows.limit(k).count() < k:
            return fitted(np.zeros((0, len(names))), float("inf"), 0)
        centres = _class_means(df, expressions, start, columns) if start is not None else _seeds(rows, names, k, metric, restarts, seed)
        active, before, best = set(range(len(centres))), [float("inf")] * len(centres), None
        for turn in range(1, rounds + 1):
            sums = _summed(rows, names, {r: centres[r] for r in sorted(active)}, metric)
            inertia = {r: sum(s[3] for s in sums if s[0] == r) for r in active}
            for r in sorted(active):
                if abs(before[r] - inertia[r]) < tolerance or turn == rounds:
                    if best is None or inertia[r] < best[0]:
                        best = (inertia[r], centres[r].copy(), turn)
                    active.discard(r)
                before[r] = inertia[r]
            for r, c, n, _, *total in sums:
                if r in active:
                    centres[r][c] = np.array(total, float) / n
            if not active:
                break
        return fitted(best[1], best[0], best[2])
    finally:
        rows.unpersist()


def elbow(df: DataFrame, columns: list[str], numbers: range, **how) -> tuple[DataFrame, int]:
    """((k, inertia), chosen k): the inertia for each number of classes, and where it bends most (largest second difference)."""
    start = how.pop("start", None)
    told = [(k, float(k_means(df, columns, k, start=start(k) if start else None, **how).inertia)) for k in numbers]
    bends = [(a - 2 * b + c, k) for (_, a), (k, b), (_, c) in zip(told, told[1:], told[2:], strict=False)]
    best = max(bends, key=lambda x: (x[0], -x[1]), default=(0.0, told[0][0]))
    return df.sparkSession.createDataFrame(told, "k int, inertia double"), best[1] if best[0] > 0 else told[0][0]


def silhouettes(df: DataFrame, fit: Clusters, asked: int = 500, name: str = "cluster") -> DataFrame:
    """(cluster, a, b, silhouette) of at most ``asked`` complete rows, chosen by a hash of their features, each against all rows.

    a is the mean distance to the rest of the row's class, b the least mean distance to another class, the silhouette (b - a) / max(a, b).  The asked
    rows, a bounded number, go to all tasks; what comes back are sums by asked row and class, one set a task.
    """
    names, size = fit.names, len(fit.centres)
    rows = complete(df, fit.columns).select(*[x.alias(c) for c, x in fit.expressions.items()])
    picked = rows.orderBy(F.xxhash64(*names), *names).limit(asked if size else 0).collect()
    points = np.array(picked, float).reshape(len(picked), len(names))
    metric, centres = fit.metric, fit.centres
    own = _pairwise(points, centres, metric).argmin(axis=1) if size else []

    def told(batches):
        import pyarrow as pa

        total, count = np.zeros((len(points), size)), np.zeros(size, np.int64)
        for batch in batches:
            block = _block(batch, names)
            if not size or not len(block):
                continue
            cluster = _pairwise(block, centres, metric).argmin(axis=1)
            count += np.bincount(cluster, minlength=size)
            for c in range(size):
                mine = block[cluster == c]
                # So few rows at once that their distances stay in a core's cache.
                for at in range(0, len(mine), CACHED // max(1, len(points))):
                    total[:, c] += _pairwise(points, mine[at : at + CACHED // max(1, len(points))], metric).sum(axis=1)
        i, c = np.meshgrid(np.arange(len(points)), np.arange(size), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(total.ravel()), pa.array(np.tile(count, len(points)))], names=["i", "c", "total", "n"])

    sums = rows.mapInArrow(told, "i int, c int, total double, n long").groupBy("i", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = df.sparkSession.createDataFrame(list(enumerate(map(int, own))), f"i int, {name} int")
    same = F.col("c") == F.col(name)
    per = sums.join(mine, "i").groupBy("i", name).agg(
        F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same & (F.col("n") > 0), F.col("total") / F.col("n"))).alias("b")
    )
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", "a", F.lit(0.0))
    return per.select(name, a.alias("a"), b.alias("b"), F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0).alias("silhouette"))


def _pairwise(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("euclidean", "logratio", "manhattan"):
        if len(left) > len(right):  # the longer side lies along memory
            return _pairwise(right, left, metric).T
        total, step = np.zeros((len(left), len(right))), np.empty((len(left), len(right)))
        for a, b in zip(left.T, np.ascontiguousarray(right.T), strict=True):
            np.subtract(a[:, None], b, out=step)
            np.abs(step, out=step) if metric == "manhattan" else np.multiply(step, step, out=step)
            total += step
        return total if metric == "manhattan" else np.sqrt(total, out=total)
    if metric == "correlation":
        left, right = left - left.mean(axis=1, keepdims=True), right - right.mean(axis=1, keepdims=True)
    length = np.sqrt((left**2).sum(axis=1)[:, None] * (right**2).sum(axis=1)[None, :])
    return 1 - np.divide(left @ right.T, length, out=np.zeros_like(length), where=length > 0)
