"""Normal scores of ranks, a normality test, and the quality of elements by their share below detection."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete
from corelode.operators.ordering import average_ranks, ranked

# Rational approximation of the normal quantile, polynomial of the normal tail.
_C, _D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_quantile(p: Column) -> Column:
    """Normal quantile of a share, to about 0.0005; 6 and -6 at the ends."""
    half = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(half))
    z = t - (_C[0] + t * (_C[1] + t * _C[2])) / (1 + t * (_D[0] + t * (_D[1] + t * _D[2])))
    return F.when((p <= 0) | (p >= 1), F.when(p < 0.5, -6.0).otherwise(6.0)).when(p < 0.5, -z).otherwise(z)


def normal_share(z: Column) -> Column:
    """Share of a normal distribution below z, by a polynomial of the tail."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(_TAIL):
        poly = t * (c + poly)
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def probability_plot(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Known rows with ``rank`` (ties by ``order``), ``n_score``, ``probability`` and ``cumulative`` percent.

    The plotting position of rank i of n is (i - 0.5) / n; ranks are counted in parts, not in one task.
    """
    rows = complete(df, [column]).withColumn("__v", F.col(column).cast("double"))
    n = rows.count()
    p = (F.col("rank") - 0.5) / max(n, 1)
    found = ranked(rows, "__v", ["__v", *order], "rank")
    return found.withColumns({"n_score": normal_quantile(p), "probability": 100 * p, "cumulative": 100 * F.col("rank") / max(n, 1)}).drop("__v")


def percentile_rank(df: DataFrame, column: str, name: str = "percentile") -> DataFrame:
    """``df`` with the share of other known rows below each value, from 0 to 1, ties at their mean; null without a value, 0 for a single one."""
    known = complete(df, [column]).count()
    rows = average_ranks(df.withColumn("__v", F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))), "__v", "__r")
    return rows.withColumn(name, (F.col("__r") - 1) / max(known - 1, 1)).drop("__v", "__r")


def emphasis(df: DataFrame, column: str, least: float = 0.1, power: float = 1.0) -> DataFrame:
    """``df`` with ``opacity`` from ``least`` to 1, rising with the percentile rank to a power; ``least`` without a value."""
    rank = percentile_rank(df, column, "__p")
    return rank.withColumn("opacity", F.coalesce(least + (1 - least) * F.pow("__p", F.lit(power)), F.lit(least))).drop("__p")


def anderson_darling(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(n, statistic, p) of normality: one row; statistic and p are null under 8 values or without spread.

    Each value enters with two weights that follow from its rank, so the sum needs no meeting of the i-th smallest with the i-th largest.
    """
    rows = complete(df, [column]).withColumn("__v", F.col(column).cast("double"))
    n, mean, spread = rows.agg(F.count("*"), F.avg("__v"), F.stddev_samp("__v")).first()
    table = "n long, statistic double, p double"
    if n < 8 or not spread:
        return df.sparkSession.createDataFrame([(n, None, None)], table)
    share = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), normal_share((F.col("__v") - F.lit(mean)) / F.lit(spread))))
    r = F.col("__rank")
    told = ranked(rows, "__v", ["__v", *order], "__rank").agg(F.sum((2 * r - 1) * F.ln(share) + (2 * (n - r) + 1) * F.ln(1 - share)).alias("s"))
    a = -n - F.col("s") / n
    star = a * (1 + 0.75 / n + 2.25 / (n * n))
    p = F.when(star < 0.2, 1 - F.exp(-13.436 + 101.14 * star - 223.73 * star * star)).when(star < 0.34, 1 - F.exp(-8.318 + 42.796 * star - 59.938 * star * star))
    p = p.when(star < 0.6, F.exp(0.9177 - 4.279 * star - 1.38 * star * star)).otherwise(F.exp(1.2937 - 5.709 * star + 0.0186 * star * star))
    return told.select(F.lit(n).cast("long").alias("n"), star.alias("statistic"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))


def element_quality(df: DataFrame, columns: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """(element, below, n, percent_below, n_score, acceptable): the normal score of the share at or below the detection limit must be under -1.

    Without a limit, values equal to the least count as below it.  No values: percent 100, score 0, not acceptable.
    """
    v = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    lowest = df.agg(*[F.min(x) for x in v.values()]).first()
    cut = {c: (limits or {}).get(c, low) for c, low in zip(columns, lowest, strict=True)}
    told = df.agg(*[f for c, x in v.items() for f in (F.count(x), F.count(F.when(x <= F.lit(cut[c]), 1)))]).first()
    rows = []
    for k, c in enumerate(columns):
        n, below = told[2 * k], told[2 * k + 1]
        share = below / n if n else 1.0
        score = 0.0 if not n else -4.0 if share <= 0 else 4.0 if share >= 1 else NormalDist().inv_cdf(share)
        rows.append((c, below, n, 100 * share, score, bool(n) and score < -1))
    return df.sparkSession.createDataFrame(rows, "element string, below long, n long, percent_below double, n_score double, acceptable boolean")
