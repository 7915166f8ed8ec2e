"""Lines and distances that outliers do not move: reweighted and trimmed least squares, trimmed covariance."""

from __future__ import annotations

import math
from functools import reduce
from operator import add
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete
from corelode.operators.multivariate import moments
from corelode.operators.ordering import quantiles, smallest
from corelode.operators.stats import _with

#: Median deviations to deviations; tuning constants of the weights; least scale, weight sum and spread of x to go on with.
SCALE, HUBER, BISQUARE, LEAST = 1.4826, 1.345, 4.685, 1e-10
#: Groups whose lines the driver holds at most (five numbers each).
MOST_GROUPS = 100_000


def _weight(u: Column, kind: str) -> Column:
    if kind == "huber":
        return F.when(F.abs(u) <= HUBER, 1.0).otherwise(F.lit(HUBER) / F.abs(u))
    if kind == "bisquare":
        left = 1 - (u / BISQUARE) ** 2
        return F.when(F.abs(u) <= BISQUARE, left * left).otherwise(0.0)
    raise ValueError(f"unknown weights {kind}")


def _told(rows: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of ``x`` and ``y`` by group; slope 0 without spread of x."""
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    return m.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))


def _lines(spark, fits: dict, rows_schema, by: list[str]) -> DataFrame:
    fields = ", ".join([f"`{c}` {rows_schema[c].dataType.simpleString()}" for c in by] + ["slope double", "intercept double"])
    # At most MOST_GROUPS rows: sent to all tasks, so that no group's rows meet in one.
    return F.broadcast(spark.createDataFrame([(*key, *fit) for key, fit in fits.items()], fields))


def _known(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return complete(df, [x, y]).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def _off(rows: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their residual ``r`` from the line of their group."""
    return _with(rows, lines, by).withColumn("r", F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept"))).drop("slope", "intercept")


def _scales(off: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, scale): 1.4826 median deviations of the residuals from their median."""
    middle = quantiles(off, {"__m": "r"}, [0.5], by, n).withColumn("__m", F.col("__m")[0])
    away = _with(off, middle, by).withColumn("away", F.abs(F.col("r") - F.col("__m")))
    return quantiles(away, {"scale": "away"}, [0.5], by, n).withColumn("scale", F.lit(SCALE) * F.col("scale")[0])


def _report(rows: DataFrame, fits: dict, by: list[str], schema, n: int) -> DataFrame:
    """(by, slope, intercept, r2, scale, slope_se, intercept_se, n): figures over all rows of each fitted line."""
    off = _off(rows, _lines(rows.sparkSession, fits, schema, by), by)
    base = _told(rows, by).select(*by, "n", "mx", "sxx", "syy")
    left = off.groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("sse"))
    out = _with(_with(_with(base, left, by), _scales(off, by, n), by), _lines(rows.sparkSession, fits, schema, by), by)
    r2 = F.when(F.col("syy") > 0, 1 - F.col("sse") / F.col("syy")).otherwise(0.0)
    slope_se = F.when(F.col("sxx") > 0, F.col("scale") / F.sqrt("sxx")).otherwise(0.0)
    intercept_se = F.col("scale") * F.sqrt(1 / F.col("n") + F.try_divide(F.col("mx") ** 2, F.col("sxx")))
    return out.select(*by, "slope", "intercept", r2.alias("r2"), "scale", slope_se.alias("slope_se"), intercept_se.alias("intercept_se"), "n")


def _start(rows: DataFrame, by: list[str]) -> dict:
    found = _told(rows, by).select(*by, "slope", "intercept").limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups")
    return {tuple(r)[: len(by)]: (r["slope"], r["intercept"]) for r in found if r["intercept"] is not None}


def reweighted(df: DataFrame, x: str, y: str, kind: str = "huber", by: list[str] = (), rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """Line of M-estimation, for each group: least squares reweighted by residuals over their scale.

    A round takes exact medians of the residuals and one weighted aggregation, for all groups that still move.  A group stops when slope and
    intercept change by less than ``tolerance``, or where scale, weights or the weighted spread of x vanish; a perfect line stays.  Rows without finite
    x and y are left out; a null group is a group; an empty table gives no rows.
    """
    by = list(by)
    rows = _known(df, x, y, by).persist()
    try:
        n, fits = rows.count(), _start(rows, by)
        active = set(fits)
        for _ in range(rounds):
            if not active:
                break
            off = _off(rows, _lines(rows.sparkSession, {g: fits[g] for g in active}, df.schema, by), by)
            both = _with(off, _scales(off, by, n), by).where(F.col("scale") >= LEAST)
            w = both.withColumn("w", _weight(F.col("r") / F.col("scale"), kind))
            part = lambda c: F.sum(F.col("w") * c)
            sums = w.groupBy(*by).agg(F.sum("w"), part(F.col("x")), part(F.col("y")), part(F.col("x") * F.col("x")), part(F.col("x") * F.col("y"))).collect()
            seen = set()
            for s in sums:
                key, (sw, sx, sy, sxx, sxy) = tuple(s)[: len(by)], tuple(s)[len(by) :]
                spread = sxx - sx * sx / sw if sw is not None and sw >= LEAST else 0.0
                if abs(spread) < LEAST:
                    continue
                slope = (sxy - sx * sy / sw) / spread
                line = (slope, (sy - slope * sx) / sw)
                if all(abs(a - b) < tolerance for a, b in zip(line, fits[key], strict=True)):
                    continue
                fits[key] = line
                seen.add(key)
            active = seen
        return _report(rows, fits, by, df.schema, n)
    finally:
        rows.unpersist()


def _elemental_start(rows: DataFrame, share: float, sample: int, pairs: int, seed: int) -> tuple[float, float] | None:
    """The line through two sampled rows whose ``share`` smallest squared residuals in the sample have the least sum."""
    picked = rows.orderBy(F.xxhash64("x", "y", F.lit(seed)), "x", "y").limit(sample).select("x", "y").collect()
    at = np.array([tuple(r) for r in picked], float).reshape(-1, 2)
    if len(at) < 2:
        return None
    draw, h = np.random.default_rng(seed), max(2, int(len(at) * share))
    i, j = draw.integers(0, len(at), pairs), draw.integers(0, len(at), pairs)
    dx = at[j, 0] - at[i, 0]
    fit = np.abs(dx) >= LEAST
    slope = (at[j, 1] - at[i, 1])[fit] / dx[fit]
    intercept = at[i, 1][fit] - slope * at[i, 0][fit]
    if not len(slope):
        return None
    squares = np.partition((at[None, :, 1] - slope[:, None] * at[None, :, 0] - intercept[:, None]) ** 2, h - 1, axis=1)[:, :h].sum(axis=1)
    best = int(squares.argmin())
    return float(slope[best]), float(intercept[best])


def trimmed(df: DataFrame, x: str, y: str, share: float = 0.75, start: str = "pairs", steps: int = 10, sample: int = 2000, pairs: int = 500, seed: int = 1) -> DataFrame:
    """Line of least trimmed squares over the ``share`` of rows with the smallest squared residuals; one row like ``reweighted``'s, and the sum ``trimmed_ss``.

    It starts from the best of ``pairs`` lines through two rows of a sample of at most ``sample`` rows (chosen by hash; the
    sample only starts the search), or from least squares (``start="ols"``).  Each step takes the exact cut of the
    squared residuals of all rows and refits on those below it; equal residuals at the cut stay together.
    """
    rows = _known(df, x, y, []).persist()
    try:
        n = rows.count()
        fits = _start(rows, [])
        if start == "pairs":
            found = _elemental_start(rows, share, sample, pairs, seed)
            fits = {(): found} if found and fits else fits
        if n < 2 or not fits:
            return _report(rows, fits, [], df.schema, n).withColumn("trimmed_ss", F.lit(0.0))
        h, best = max(2, math.floor(n * share)), None
        for _ in range(steps + 1):
            slope, intercept = fits[()]
            off = rows.withColumn("r2", (F.col("y") - (F.lit(slope) * F.col("x") + F.lit(intercept))) ** 2)
            kept = smallest(off, "r2", h, n).persist()
            try:
                line = tuple(_told(kept, []).select("slope", "intercept").first())
                own, refit = kept.agg(F.sum("r2"), F.sum((F.col("y") - (F.lit(line[0]) * F.col("x") + F.lit(line[1]))) ** 2)).first()
            finally:
                kept.unpersist()
            best = own if best is None else best
            if refit >= best - LEAST:
                break
            best, fits = refit, {(): line}
        return _report(rows, fits, [], df.schema, n).withColumn("trimmed_ss", F.lit(float(best)))
    finally:
        rows.unpersist()


def chi_square_cutoff(columns: int, alpha: float = 0.05) -> float:
    """Wilson-Hilferty value of chi-square with the normal quantile taken at (1 + alpha) / 2."""
    z = abs(NormalDist().inv_cdf(1 - (1 - alpha) / 2))
    return max(0.0, columns * (1 - 2 / (9 * columns) + z * math.sqrt(2 / (9 * columns))) ** 3)


def trimmed_mahalanobis(df: DataFrame, columns: list[str], alpha: float = 0.05, share: float = 0.75, steps: int = 1) -> DataFrame:
    """Complete rows with ``distance`` from the mean of the nearest ``share`` of rows under their covariance, and ``is_anomaly`` beyond the chi-square cut.

    Each of ``steps`` takes the nearest rows under the last mean and covariance (equal distances stay together).  Directions without spread do not count;
    no more rows than columns give distances of null and no anomaly.
    """
    rows = complete(df, columns)
    n, means, covariance = moments(df, columns)
    if n <= len(columns):
        return rows.withColumns({"distance": F.lit(None).cast("double"), "is_anomaly": F.lit(False)})

    def square(means, covariance) -> Column:
        away = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, means, strict=True)]
        inverse = np.linalg.pinv(covariance, hermitian=True)
        return reduce(add, [a * reduce(add, [b * F.lit(float(w)) for b, w in zip(away, row, strict=True)]) for a, row in zip(away, inverse, strict=True)])

    for _ in range(steps):
        near = smallest(rows.withColumn("__d2", square(means, covariance)), "__d2", max(1, math.floor(share * n)), n)
        _, means, covariance = moments(near, columns)
    distance = F.sqrt(F.greatest(square(means, covariance), F.lit(0.0)))
    return rows.withColumn("distance", distance).withColumn("is_anomaly", F.col("distance") > math.sqrt(chi_square_cutoff(len(columns), alpha)))


def adjusted(df: DataFrame, y: str, columns: list[str], kind: str = "huber", rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``residual`` and ``adjusted``, (step, column, slope, intercept)): y with one column after the other regressed out.

    Each step fits the residuals of the one before by ``huber``, ``bisquare``, ``lts`` or ``ols``; ``adjusted`` puts the mean of y back.  A row
    without a finite value of y or of a column has neither from there on.
    """
    v = F.col(y).cast("double")
    rows = df.withColumn("residual", F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))
    mean, lines = rows.agg(F.avg("residual")).first()[0], []
    for k, c in enumerate(columns):
        if kind == "ols":
            fit = _told(_known(rows, c, "residual", []), []).select("slope", "intercept").first()
        else:
            fit = (trimmed(rows, c, "residual") if kind == "lts" else reweighted(rows, c, "residual", kind, rounds=rounds)).select("slope", "intercept").first()
        slope, intercept = (0.0, 0.0) if fit is None or fit[1] is None else fit
        lines.append((k + 1, c, slope, intercept))
        x = F.col(c).cast("double")
        known = ~F.isnan(x) & (F.abs(x) != float("inf"))
        rows = rows.withColumn("residual", F.when(known, F.col("residual") - (F.lit(slope) * x + F.lit(intercept))))
    table = df.sparkSession.createDataFrame(lines, "step int, column string, slope double, intercept double")
    return rows.withColumn("adjusted", F.col("residual") + F.lit(mean)), table
