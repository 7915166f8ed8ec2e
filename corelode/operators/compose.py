"""Compositional transforms: zero replacement and log-ratios."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_zeros(df: DataFrame, parts: list[str], share: float = 0.5) -> DataFrame:
    """Null, NaN, zero and negative parts become ``share`` of the least positive value of all parts (one broadcast row)."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    least = df.agg(F.least(*[F.min(positive(c)) for c in parts]).alias("__least"))
    fixed = {c: F.coalesce(positive(c), F.col("__least") * share) for c in parts}
    return df.join(F.broadcast(least)).withColumns(fixed).drop("__least")


def _mean_log(parts: list[str]) -> Column:
    return sum((F.ln(c) for c in parts[1:]), F.ln(parts[0])) / len(parts)


def clr(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.withColumns({f"clr_{c}": F.ln(c) - _mean_log(parts) for c in parts})


def log_ratio(a: str, b: str) -> Column:
    """ln(a / b); 0 where either is not positive."""
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.ln(F.col(a)) - F.ln(F.col(b))).otherwise(0.0)


def alr(df: DataFrame, parts: list[str], reference: str) -> DataFrame:
    if reference not in parts:
        raise ValueError("the reference is not a part")
    return df.withColumns({f"alr_{c}": log_ratio(c, reference) for c in parts if c != reference})


def plr(df: DataFrame, parts: list[str]) -> DataFrame:
    """All pairs of parts; 0 where a ratio is undefined."""
    return df.withColumns({f"plr_{a}_{b}": log_ratio(a, b) for a, b in combinations(parts, 2)})


def ilr(df: DataFrame, parts: list[str]) -> DataFrame:
    """Pivot coordinates: each part against the geometric mean of those after it."""
    out = {}
    for k in range(len(parts) - 1):
        r = len(parts) - k - 1
        out[f"ilr_{k + 1}"] = math.sqrt(r / (r + 1)) * (F.ln(parts[k]) - _mean_log(parts[k + 1 :]))
    return df.withColumns(out)


def slr(df: DataFrame, over: list[str], under: list[str], name: str) -> DataFrame:
    """Log of a ratio of sums; null parts are left out of the sums."""
    total = lambda cs: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cs[1:]), F.coalesce(F.col(cs[0]).cast("double"), F.lit(0.0)))
    a, b = total(over), total(under)
    return df.withColumn(name, F.when((a > 0) & (b > 0), F.ln(a / b)))


def variation(df: DataFrame, parts: list[str]) -> DataFrame:
    """(part_i, part_j, variance of the log ratio) over rows where all parts are positive."""
    whole = df
    for c in parts:
        whole = whole.where(F.col(c) > 0)
    cells = [F.struct(F.lit(a).alias("part_i"), F.lit(b).alias("part_j"), F.var_samp(F.ln(F.col(a) / F.col(b))).alias("variance")) for a, b in combinations(parts, 2)]
    return whole.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def classify_zeros(df: DataFrame, key: list[str], parts: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """(key, part, type, limit) of every zero or missing cell: below-dl where a limit is known, else missing or unknown."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("part"), F.col(c).cast("double").alias("v"), F.lit((limits or {}).get(c)).cast("double").alias("limit")) for c in parts
    ])).alias("r")
    rows = df.select(*key, cells).select(*key, "r.*").where("v is null or v = 0 or isnan(v)")
    kind = F.when(F.col("limit").isNotNull(), "below-dl").when(F.col("v").isNull(), "missing").otherwise("unknown")
    return rows.select(*key, "part", kind.alias("type"), "limit")


def _positive(c: str) -> Column:
    return F.when((F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def replace_by_limit(df: DataFrame, parts: list[str], limits: dict[str, float]) -> DataFrame:
    """Zero and missing parts become half their detection limit; parts without a limit half the least positive value of all."""
    least = df.agg(F.least(*[F.min(_positive(c)) for c in parts]).alias("__least")) if len(parts) > 1 else df.agg(F.min(_positive(parts[0])).alias("__least"))
    half = lambda c: F.lit(limits[c] / 2) if c in limits else F.coalesce("__least", F.lit(0.001)) / 2
    return df.join(least).withColumns({c: F.coalesce(_positive(c), half(c)) for c in parts}).drop("__least")


def replace_multiplicative(df: DataFrame, parts: list[str]) -> DataFrame:
    """Row by row: zeros become 0.65 of the row's least positive part, the others shrink so that their sum with the zeros stays; a row of zeros becomes 0.001."""
    values = F.array(*[_positive(c) for c in parts])
    there = F.filter(values, lambda v: v.isNotNull())
    delta, total = F.array_min(there) * 0.65, F.aggregate(there, F.lit(0.0), lambda a, v: a + v)
    zeros = len(parts) - F.size(there)
    shrunk = df.withColumn("__delta", delta).withColumn("__f", F.try_divide(total - zeros * delta, total)).withColumn("__none", F.size(there) == 0)
    fixed = {c: F.when(F.col("__none"), 0.001).otherwise(F.coalesce(_positive(c) * F.col("__f"), F.col("__delta"))) for c in parts}
    return shrunk.withColumns(fixed).drop("__delta", "__f", "__none")


def geometric_mean(parts: list[str]) -> Column:
    """Of the positive parts; 0 where there is none."""
    logs = [F.ln(_positive(c)) for c in parts]
    total, many = sum((F.coalesce(v, F.lit(0.0)) for v in logs), F.lit(0.0)), sum((v.isNotNull().cast("int") for v in logs), F.lit(0))
    return F.when(many > 0, F.exp(total / many)).otherwise(0.0)


def inverse_clr(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Parts that sum to 1 from centred log-ratios."""
    most = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    total = sum((F.exp(F.col(c) - most) for c in columns), F.lit(0.0))
    return df.withColumns({n: F.exp(F.col(c) - most) / total for c, n in zip(columns, names, strict=True)})


def chi_power(df: DataFrame, parts: list[str], power: float = 0.25) -> DataFrame:
    """Box-Cox transform of each part's share over the product of its row's and column's shares; the logarithm at power 0.

    Missing and negative parts count as 0.  Column sums are one row.
    """
    value = lambda c: F.when(F.col(c) >= 0, F.nanvl(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0)
    sums = df.agg(*[F.sum(value(c)).alias(f"__s_{c}") for c in parts])
    rows, total = sum((value(c) for c in parts), F.lit(0.0)), sum((F.col(f"__s_{c}") for c in parts), F.lit(0.0))

    def one(c: str) -> Column:
        ratio = F.try_divide(value(c) * total, rows * F.col(f"__s_{c}"))
        if power == 0:
            return F.when(ratio > 0, F.ln(ratio)).otherwise(0.0)
        return F.when(ratio.isNull(), 0.0).when(ratio > 0, (F.pow(ratio, F.lit(power)) - 1) / power).otherwise(-1 / power)

    return df.join(sums).withColumns({f"chi_{c}": one(c) for c in parts}).drop(*[f"__s_{c}" for c in parts])


def total_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sum of the columns' sample variances."""
    return df.agg(sum((F.var_samp(c) for c in columns), F.lit(0.0)).alias("total"))


def best_power(df: DataFrame, parts: list[str], powers: tuple[float, ...] = (0.1, 0.25, 0.33, 0.5, 0.75, 1.0)) -> DataFrame:
    """(power, total) of the transform of largest total variance among a few powers."""
    out = None
    for p in powers:
        one = total_variance(chi_power(df, parts, p), [f"chi_{c}" for c in parts]).select(F.lit(p).alias("power"), "total")
        out = one if out is None else out.union(one)
    return out.orderBy(F.desc("total"), "power").limit(1)


def variance_decomposition(df: DataFrame, parts: list[str]) -> DataFrame:
    """(part_i, part_j, variance, share) of all log-ratios over complete rows; shares are of their sum over the number of parts squared."""
    found = variation(df, parts).withColumn("variance", F.col("variance"))
    total = found.agg(F.sum("variance").alias("__t"))
    return found.join(total).select("part_i", "part_j", "variance", (100 * F.try_divide("variance", "__t")).alias("share"))


def log_additive(df: DataFrame, columns: list[str], name: str, share: float = 0.65) -> DataFrame:
    """Sum of log10; a value that is not positive becomes ``share`` of its column's least positive, a missing one makes the sum null."""
    least = df.agg(*[F.min(_positive(c)).alias(f"__m_{c}") for c in columns])
    one = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), None).otherwise(F.log10(F.coalesce(_positive(c), F.coalesce(F.col(f"__m_{c}"), F.lit(0.001)) * share)))
    return df.join(least).withColumn(name, sum((one(c) for c in columns), F.lit(0.0))).drop(*[f"__m_{c}" for c in columns])


#: Replacement of a part that is not positive, by the least positive value of all parts: share of it.
ZERO_MODES = {"half-min": 0.5, "small-constant": 0.65}


def replaced(df: DataFrame, parts: list[str], mode: str = "half-min", value: float | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """Null, NaN, zero and negative parts by a share of the least positive value of all parts (0.001 without any), half a part's limit, or a value.

    ``half-min``, ``small-constant`` (``value``, else 0.65 of the least), ``half-dl`` (half of ``limits``, else of the least), ``custom`` (``value``, else 0.001).
    """
    if mode not in (*ZERO_MODES, "half-dl", "custom"):
        raise ValueError(f"unknown mode {mode}")
    v = {c: F.col(c).cast("double") for c in parts}
    positive = {c: F.when((x > 0) & ~F.isnan(x), x) for c, x in v.items()}
    if mode == "custom" or (mode == "small-constant" and value is not None):
        return df.withColumns({c: F.coalesce(positive[c], F.lit(0.001 if value is None else value)) for c in parts})
    lows = [F.min(x) for x in positive.values()]
    least = df.agg(F.coalesce(F.least(*lows) if len(lows) > 1 else lows[0], F.lit(0.001)).alias("__least"))
    share = ZERO_MODES.get(mode, 0.5)
    other = {c: F.lit(limits[c] / 2) if mode == "half-dl" and limits and c in limits else F.col("__least") * share for c in parts}
    return df.join(least).withColumns({c: F.coalesce(positive[c], other[c]) for c in parts}).drop("__least")


def _whole(df: DataFrame, parts: list[str]) -> DataFrame:
    for c in parts:
        v = F.col(c).cast("double")
        df = df.where((v > 0) & ~F.isnan(v) & (v != float("inf")))
    return df


def clr_covariance(df: DataFrame, parts: list[str]) -> DataFrame:
    """(col_i, col_j, covariance, correlation) of centred log-ratios over rows with all parts positive; correlation 0 without spread."""
    rows = clr(_whole(df, parts), parts)
    at = {c: F.col(f"clr_{c}") for c in parts}
    cells = []
    for i, a in enumerate(parts):
        for b in parts[i:]:
            spread = F.stddev_samp(at[a]) * F.stddev_samp(at[b])
            cells.append(F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.covar_samp(at[a], at[b]).alias("covariance"), F.coalesce(F.try_divide(F.covar_samp(at[a], at[b]), spread), F.lit(0.0)).alias("correlation")))
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def log_ratio_analysis(df: DataFrame, parts: list[str]) -> DataFrame:
    """(component, part, loading, variance_pct): principal axes of the centred log-ratios' covariance, largest first; no rows without whole ones.

    Only the covariance, whose size is that of the parts, reaches the driver.  The largest entry of an axis is positive.
    """
    import numpy as np

    rows = clr_covariance(df, parts).collect()
    table = "component int, part string, loading double, variance_pct double"
    if any(r["covariance"] is None for r in rows):
        return df.sparkSession.createDataFrame([], table)
    place = {c: k for k, c in enumerate(parts)}
    matrix = np.zeros((len(parts), len(parts)))
    for r in rows:
        i, j = place[r["col_i"]], place[r["col_j"]]
        matrix[i, j] = matrix[j, i] = r["covariance"]
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(parts))] < 0, -1.0, 1.0)
    total = values.sum() or 1.0
    told = [(k + 1, c, float(vectors[j, k]), float(100 * values[k] / total)) for k in range(len(parts) - 1) for j, c in enumerate(parts)]
    return df.sparkSession.createDataFrame(told, table)


#: Rows of which all pairs are compared; beyond, so many by a hash of their parts.
MOST_COMPARED = 1_000


def reference_ranking(df: DataFrame, parts: list[str], most: int = MOST_COMPARED) -> DataFrame:
    """(reference, correlation) by falling fit: how the distances of additive log-ratios with each reference follow those of the centred ones.

    Over all pairs of at most ``most`` rows with positive parts, chosen by a hash where there are more; the pairs of this bounded sample are a join.
    0 below three rows or without spread.
    """
    rows = clr(_whole(df, parts), parts).select(*[F.ln(c).alias(f"l_{c}") for c in parts], *[f"clr_{c}" for c in parts])
    some = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(most).withColumn("__i", F.monotonically_increasing_id()).persist()
    left, right = some.select(*[F.col(c).alias(f"a_{c}") for c in some.columns]), some.select(*[F.col(c).alias(f"b_{c}") for c in some.columns])
    pairs = left.join(right, F.col("a___i") < F.col("b___i"))
    away = lambda c: F.col(f"a_{c}") - F.col(f"b_{c}")
    root = lambda xs: F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
    told = pairs.select(root([away(f"clr_{c}") for c in parts]).alias("exact"), *[root([away(f"l_{c}") - away(f"l_{r}") for c in parts if c != r]).alias(f"d_{r}") for r in parts])
    fit = lambda r: F.coalesce(F.try_divide(F.covar_pop("exact", f"d_{r}"), F.stddev_pop("exact") * F.stddev_pop(f"d_{r}")), F.lit(0.0))
    return told.agg(F.array(*[F.struct(F.lit(r).alias("reference"), fit(r).alias("correlation")) for r in parts]).alias("c")).select(F.inline("c"))


def matched_columns(wanted: list[str], columns: list[str]) -> dict[str, str]:
    """The column of each wanted part: the same name in any case, else the first that holds it or is held by it."""
    out = {}
    for w in wanted:
        exact = [c for c in columns if c.lower() == w.lower()]
        near = [c for c in columns if w.lower() in c.lower() or c.lower() in w.lower()]
        if exact or near:
            out[w] = (exact or near)[0]
    return out
