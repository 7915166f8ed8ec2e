"""Operators on several columns at once: only means and covariances, whose size is fixed, reach the driver."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete
from corelode.operators.ordering import quantiles


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariances) of complete rows, in one aggregation."""
    size, v = len(columns), [F.col(c).cast("double") for c in columns]
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    row = complete(df, columns).agg(F.count("*"), *[F.avg(x) for x in v], *[F.covar_samp(v[i], v[j]) for i, j in upper]).first()
    means, covariance = np.array([x or 0.0 for x in row[1 : 1 + size]]), np.zeros((size, size))
    for (i, j), x in zip(upper, row[1 + size :], strict=True):
        covariance[i, j] = covariance[j, i] = x or 0.0
    return row[0], means, covariance


def _weighted(terms: list[Column], weights) -> Column:
    return reduce(add, [t * F.lit(float(w)) for t, w in zip(terms, weights, strict=True)])


def mahalanobis(df: DataFrame, columns: list[str], cutoff: float) -> DataFrame:
    """Complete rows with ``distance`` from the mean and ``is_anomaly`` (distance above ``cutoff``).

    Directions without spread do not count (pseudo-inverse); an empty table gives no rows.
    """
    _, means, covariance = moments(df, columns)
    inverse = np.linalg.pinv(covariance)
    away = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, means, strict=True)]
    square = reduce(add, [a * _weighted(away, row) for a, row in zip(away, inverse, strict=True)])
    distance = F.sqrt(F.greatest(square, F.lit(0.0)))
    return complete(df, columns).withColumn("distance", distance).withColumn("is_anomaly", F.col("distance") > cutoff)


def principal_components(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, eigenvalues, eigenvectors by column) of the correlation matrix, largest first.

    A column without spread correlates with nothing but itself; the largest entry of each vector is positive.
    """
    _, means, covariance = moments(df, columns)
    spread = np.sqrt(np.diag(covariance))
    safe = np.where(spread > 0, spread, 1.0)
    correlation = covariance / np.outer(safe, safe)
    np.fill_diagonal(correlation, 1.0)
    values, vectors = np.linalg.eigh(correlation)
    values, vectors = values[::-1], vectors[:, ::-1]
    peak = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))]
    return means, np.maximum(values, 0.0), vectors * np.where(peak < 0, -1.0, 1.0)


def pca_scores(df: DataFrame, columns: list[str], components: int = 2) -> DataFrame:
    """Complete rows with pc1, pc2, ...: centred values on the eigenvectors, not scaled by deviations."""
    means, _, vectors = principal_components(df, columns)
    away = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, means, strict=True)]
    return complete(df, columns).select("*", *[_weighted(away, vectors[:, k]).alias(f"pc{k + 1}") for k in range(components)])


def pca_loadings(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, column, loading, variance_pct); a loading is an eigenvector's entry times the root of its value; no rows without complete ones."""
    if complete(df, columns).isEmpty():
        return df.sparkSession.createDataFrame([], "component int, column string, loading double, variance_pct double")
    _, values, vectors = principal_components(df, columns)
    rows = [
        (k + 1, c, float(vectors[j, k] * np.sqrt(values[k])), float(100 * values[k] / values.sum()))
        for k in range(len(columns))
        for j, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "component int, column string, loading double, variance_pct double")


def classify_by_component(df: DataFrame, score: str, share: float, label: str, positive: bool = True) -> DataFrame:
    """``df`` with ``class``: ``label`` for the ``share`` of rows at the chosen end of a score, else null."""
    # The scores alone are worked out once for the bound.
    scores = df.select(F.col(score).cast("double").alias("__score")).persist()
    try:
        bound = quantiles(scores, {"__bound": "__score"}, [1 - share if positive else share]).withColumn("__bound", F.col("__bound")[0])
    finally:
        scores.unpersist()
    passed = F.col(score) >= F.col("__bound") if positive else F.col(score) <= F.col("__bound")
    return df.join(bound).withColumn("class", F.when(passed, F.lit(label))).drop("__bound")
