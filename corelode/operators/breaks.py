"""Class breaks: equal widths, equal counts, and natural breaks by dynamic programming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete
from corelode.operators.ordering import quantiles

#: Distinct values up to which natural breaks take all of them, with their counts; beyond, so many values of even rank.
JENKS_VALUES = 10_000


def _values(df: DataFrame, column: str) -> DataFrame:
    return complete(df, [column]).select(F.col(column).cast("double").alias("v"))


def equal_breaks(df: DataFrame, column: str, classes: int) -> list[float]:
    """``classes`` + 1 breaks of equal width from the least to the largest value; none without values."""
    low, high = _values(df, column).agg(F.min("v"), F.max("v")).first()
    return [] if low is None else [low + (high - low) / classes * k for k in range(classes)] + [high]


def _ranked_values(values: DataFrame, n: int, ranks: list[int]) -> list[float]:
    """Values of the given ranks from 0."""
    return quantiles(values, {"q": "v"}, [min(1.0, r / max(1, n - 1)) for r in ranks]).first()["q"]


def quantile_breaks(df: DataFrame, column: str, classes: int) -> list[float]:
    """``classes`` + 1 breaks: the values of rank floor(n k / classes), and the largest."""
    values = _values(df, column)
    n = values.count()
    return [] if not n else _ranked_values(values, n, [n * k // classes for k in range(classes)] + [n - 1])


def optimal_partition(values: np.ndarray, weights: np.ndarray, classes: int) -> list[int]:
    """Where each class but the first starts, of the partition of rising values with the least weighted sum of squares within.

    One row of the programme at a time: the best end of each prefix in one class more.  Equal sums take the later start of the last class.
    """
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weights, weights * (values - values.mean()), weights * (values - values.mean()) ** 2))
    n = len(values)

    def within(starts: np.ndarray, end: int) -> np.ndarray:
        total, first, second = w[end] - w[starts], s[end] - s[starts], q[end] - q[starts]
        return np.maximum(second - first * first / total, 0.0)

    best = np.array([np.inf] + [float(within(np.array([0]), e)[0]) for e in range(1, n + 1)])
    cuts = np.zeros((classes + 1, n + 1), np.int64)
    for c in range(2, classes + 1):
        after = np.full(n + 1, np.inf)
        for e in range(c, n + 1):
            starts = np.arange(c - 1, e)
            sums = best[starts] + within(starts, e)
            k = len(sums) - 1 - int(sums[::-1].argmin())
            after[e], cuts[c, e] = sums[k], starts[k]
        best = after
    out, end = [], n
    for c in range(classes, 1, -1):
        end = int(cuts[c, end])
        out.append(end)
    return out[::-1]


def jenks_breaks(df: DataFrame, column: str, classes: int) -> list[float]:
    """``classes`` + 1 natural breaks: the least value, the first value of every further class, the largest.

    Up to JENKS_VALUES distinct values the partition is the best of all rows; beyond, of so many values of evenly spaced ranks.  No more distinct values
    than classes give all of them.
    """
    values = _values(df, column)
    counts = values.groupBy("v").agg(F.count("*").alias("m"))
    held = counts.limit(JENKS_VALUES + 1).collect()
    if not held:
        return []
    if len(held) > JENKS_VALUES:
        n = values.count()
        at = np.array(_ranked_values(values, n, [round(k * (n - 1) / (JENKS_VALUES - 1)) for k in range(JENKS_VALUES)]))
        place, weight = np.unique(at, return_counts=True)
    else:
        place, weight = np.array(sorted((r[0], r[1]) for r in held), float).T
    if len(place) <= classes:
        return place.tolist()
    return [float(place[0]), *[float(place[k]) for k in optimal_partition(place, weight.astype(float), classes)], float(place[-1])]


def class_index(value: Column, breaks: list[float]) -> Column:
    """Class from 0 of a value between breaks, half open; values outside and at the top are of the last class; null for none."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for k, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False)):
        out = out.when((value >= a) & (value < b), k)
    return out.otherwise(max(0, len(breaks) - 2))


def class_labels(breaks: list[float]) -> list[str]:
    """``low - <high`` of each class, the last closed."""
    last = len(breaks) - 2
    return [f"{a:.2f} - {b:.2f}" if k == last else f"{a:.2f} - <{b:.2f}" for k, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False))]
