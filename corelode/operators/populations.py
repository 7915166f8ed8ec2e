"""Populations of one column: Gaussian mixtures by expectation and maximisation, and modes of a smoothed histogram."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete
from corelode.operators.ordering import quantiles

#: Fewer values are not separated; the least variance of a component; the least density whose logarithm is taken.
LEAST_VALUES, LEAST_VARIANCE, LEAST_DENSITY = 20, 1e-6, 1e-300
FLOOR = 1e-10
#: Distinct values of a task in a round.
VALUES_A_TASK = 100_000


@dataclass
class Mixture:
    """One mixture: (mean, deviation, weight) of each component, and those that the last expectations were taken with."""

    parts: list[tuple[float, float, float]]
    used: list[tuple[float, float, float]] = field(default_factory=list)
    likelihood: float = -math.inf
    settled: bool = False

    def bic(self, n: float) -> float:
        return math.log(n) * (3 * len(self.parts) - 1) - 2 * self.likelihood

    def aic(self) -> float:
        return 2 * (3 * len(self.parts) - 1) - 2 * self.likelihood

    def apart(self, least: float) -> bool:
        """Whether rising means lie ``least`` mean deviations of neighbouring components apart."""
        means = sorted(m for m, _, _ in self.parts)
        return all(b - a >= least * (self.parts[i][1] + self.parts[i + 1][1]) / 2 for i, (a, b) in enumerate(zip(means, means[1:], strict=False)))


def _densities(v: Column, parts: list[tuple[float, float, float]]) -> list[Column]:
    """Weighted normal densities; 0 for a component without spread."""
    out = []
    for mean, deviation, weight in parts:
        z = (v - F.lit(mean)) / F.lit(deviation) if deviation > 0 else None
        out.append(F.lit(weight / (deviation * math.sqrt(2 * math.pi))) * F.exp(-0.5 * z * z) if deviation > 0 else F.lit(0.0))
    return out


def _scaled(column: str, log: bool) -> Column:
    v = F.col(column).cast("double")
    return F.ln(F.greatest(v, F.lit(FLOOR))) if log else v


def _expected(counts: DataFrame, fits: list[list[tuple[float, float, float]]], middle: float) -> list[list[float]]:
    """For each fit the logarithm of its likelihood and, of each component, its shares of all values: their sum, and those of share times distance from ``middle`` and its square.

    A task sums its values (v, number m) and tells one row, so a round compiles no code of its own.
    """
    least = LEAST_DENSITY

    def told(batches):
        import numpy as np
        import pyarrow as pa

        sums = [np.zeros(1 + 3 * len(parts)) for parts in fits]
        for batch in batches:
            v, m = (batch[c].to_numpy().astype(np.float64) for c in ("v", "m"))
            off = v - middle
            for held, parts in zip(sums, fits, strict=True):
                dense = [weight / (deviation * math.sqrt(2 * math.pi)) * np.exp(-0.5 * ((v - mean) / deviation) ** 2) if deviation > 0 else np.zeros(len(v)) for mean, deviation, weight in parts]
                total = sum(dense)
                held[0] += (m * np.log(np.maximum(total, least))).sum()
                for k, d in enumerate(dense):
                    share = m * np.divide(d, total, out=np.zeros(len(v)), where=total > 0)
                    held[1 + 3 * k : 4 + 3 * k] += share.sum(), (share * off).sum(), (share * off * off).sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums)], pa.list_(pa.float64()))], names=["sums"])

    rows = counts.mapInArrow(told, "sums array<double>").collect()
    sums, at = [math.fsum(c) for c in zip(*[r.sums for r in rows], strict=True)], 0
    out = []
    for parts in fits:
        out.append(sums[at : at + 1 + 3 * len(parts)])
        at += len(out[-1])
    return out


def fit_mixtures(df: DataFrame, column: str, most: int = 4, log: bool = False, rounds: int = 100, tolerance: float = 1e-6) -> tuple[int, list[Mixture]]:
    """(values, mixtures of 1 to ``most`` components), fitted side by side: a round is one pass for all that still move.

    Equal values are counted first and kept in few tasks.  Components start at the values of rank (k + 0.5) n / K with the K-th part of the deviation.  A
    component of less than one value stays as it is.  The logarithm of the likelihood is that of the components it is told with.
    """
    values = complete(df, [column]).select(_scaled(column, log).alias("v"))
    counted = values.groupBy("v").agg(F.count("*").alias("m")).persist()
    counts = counted.coalesce(max(1, math.ceil(counted.count() / VALUES_A_TASK))).persist()
    try:
        counts.count()
        counted.unpersist()
        n, middle, spread = values.agg(F.count("*"), F.avg("v"), F.stddev_samp("v")).first()
        if n < LEAST_VALUES:
            return n, []
        ranks = [(size, math.floor((k + 0.5) * n / size)) for size in range(1, most + 1) for k in range(size)]
        starts = quantiles(values, {"q": "v"}, [min(1.0, r / (n - 1)) for _, r in ranks]).first()["q"]
        mixtures = [Mixture([(v, spread / size, 1 / size) for (s, _), v in zip(ranks, starts, strict=True) if s == size]) for size in range(1, most + 1)]
        for turn in range(rounds + 1):
            active = [x for x in mixtures if not x.settled]
            for x, (likelihood, *sums) in zip(active, _expected(counts, [x.parts for x in active], middle), strict=True):
                # The first expectation is taken with the start, whose likelihood does not count.
                x.settled = turn == rounds or (turn > 1 and abs(likelihood - x.likelihood) < tolerance)
                x.likelihood = likelihood if turn else -math.inf
                if x.settled:
                    continue
                x.used, moved = list(x.parts), []
                for k, part in enumerate(x.parts):
                    held, first, second = sums[3 * k : 3 * k + 3]
                    if held > 1:
                        variance = second / held - (first / held) ** 2
                        part = (middle + first / held, math.sqrt(max(variance, LEAST_VARIANCE)), held / n)
                    moved.append(part)
                x.parts = moved
            if all(x.settled for x in mixtures):
                break
        return n, mixtures
    finally:
        counts.unpersist()


def best_mixture(n: int, mixtures: list[Mixture], least_apart: float = 0.5) -> Mixture | None:
    """The mixture of the least BIC among those whose components lie apart; the one with fewer components of equals."""
    return min((x for x in mixtures if x.apart(least_apart)), key=lambda x: x.bic(n), default=None)


def population_label(index: int, total: int) -> str:
    if total == 1 or index == 0:
        return "background"
    return "high-grade" if index == total - 1 else "anomalous" if index == total - 2 else "threshold"


_TABLE = "population int, label string, mean double, deviation double, proportion double, rows long, lower double, upper double, separation double"


def populations(df: DataFrame, column: str, most: int = 4, log: bool = False, least_apart: float = 0.5, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(populations, ``df`` with ``population``) of the mixture that ``best_mixture`` takes.

    Populations rise by mean; bounds lie two deviations off; ``separation`` from the next population weighs the means by each other's deviations.
    On the logarithmic scale means, deviations and bounds are powers of e again.  A row belongs to the component of the largest share
    in the last expectation, the first of equals; rows without a finite value, and all rows of under LEAST_VALUES values, to none.
    """
    n, mixtures = fit_mixtures(df, column, most, log, rounds)
    best = best_mixture(n, mixtures, least_apart)
    if best is None:
        return df.sparkSession.createDataFrame([], _TABLE), df.withColumn("population", F.lit(None).cast("int"))
    order = sorted(range(len(best.parts)), key=lambda k: best.parts[k][0])
    back = math.exp if log else float
    told = [(back(m), back(s), w, back(m - 2 * s), back(m + 2 * s)) for m, s, w in (best.parts[k] for k in order)]
    rows = []
    for k, (m, s, w, low, high) in enumerate(told):
        after = told[k + 1] if k + 1 < len(told) else None
        rows.append((k, population_label(k, len(told)), m, s, w, math.floor(w * n + 0.5), low, high, (m * after[1] + after[0] * s) / (s + after[1]) if after else None))
    v = _scaled(column, log)
    dense = _densities(v, best.used or best.parts)
    total = sum(dense[1:], dense[0])
    shares = F.array(*[F.when(total > 0, d / total).otherwise(0.0) for d in dense])
    place = F.array(*[F.lit(order.index(k)) for k in range(len(order))])
    raw = F.col(column).cast("double")
    known = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != float("inf"))
    chosen = F.element_at(place, F.array_position(shares, F.array_max(shares)).cast("int"))
    return df.sparkSession.createDataFrame(rows, _TABLE), df.withColumn("population", F.when(known, chosen))


def histogram_modes(df: DataFrame, column: str, bins: int = 50, most: int = 4, least_share: float = 0.02) -> DataFrame:
    """(mode, centre, n, density): local maxima of equal bins smoothed over two neighbours a side, of over ``least_share`` of the values.

    The ``most`` densest, numbered from 0 by rising centre.  Under 10 values, or without range, none.
    """
    values = complete(df, [column]).select(F.col(column).cast("double").alias("v"))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    table = "mode int, centre double, n long, density double"
    if n < 10 or high <= low:
        return df.sparkSession.createDataFrame([], table)
    width = (high - low) / bins
    held = [0] * bins
    for b, m in values.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width)).alias("b")).count().collect():
        held[b] = m
    smooth = [sum(held[max(0, i - 2) : i + 3]) / len(held[max(0, i - 2) : i + 3]) for i in range(bins)]
    peaks = [i for i in range(1, bins - 1) if smooth[i - 1] < smooth[i] > smooth[i + 1] and smooth[i] > n * least_share]
    peaks = sorted(sorted(peaks, key=lambda i: -smooth[i])[:most])
    return df.sparkSession.createDataFrame([(k, low + (i + 0.5) * width, held[i], smooth[i] / n) for k, i in enumerate(peaks)], table)
