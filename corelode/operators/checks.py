"""Ratios, sums and rules on columns: what a sheet of assays is checked by before it is used."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.operators.frames import complete
from corelode.operators.ordering import quantiles

# Oxides that should sum to about 100, and the bounds of that sum.
MAJOR_OXIDES = ("SiO2", "TiO2", "Al2O3", "Fe2O3", "FeO", "MgO", "CaO", "Na2O", "K2O", "MnO", "P2O5")
LEAST_SUM, MOST_SUM = 95.0, 105.0


def number(column: str) -> Column:
    """A column as a finite double, else null."""
    v = F.col(f"`{column}`").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def ratio(over: str, under: str) -> Column:
    """One column over another; null where either is missing, or the second is 0, or the ratio is not finite."""
    r = F.try_divide(number(over), number(under))
    return F.when(F.abs(r) != float("inf"), r)


def total(columns: list[str]) -> Column:
    """Sum of the known values; null where none is known."""
    known = reduce(lambda a, b: a | b, [number(c).isNotNull() for c in columns])
    return F.when(known, reduce(lambda a, b: a + b, [F.coalesce(number(c), F.lit(0.0)) for c in columns]))


def transformed(column: str, change) -> Column:
    """``change`` of the known values, null where the result is not finite."""
    v = change(number(column))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


@dataclass(frozen=True)
class Rule:
    """A check of one column: ``range`` (low, high), ``positive``, ``non-negative``, ``sum`` of ``columns`` between low and high, or ``custom``."""

    name: str
    column: str
    kind: str
    severity: str = "error"
    low: float | None = None
    high: float | None = None
    columns: tuple[str, ...] = ()
    #: For ``custom``: a condition that a known value must meet.
    condition: Column | None = None

    def broken(self) -> Column:
        """Whether a row breaks the rule; a missing value breaks none."""
        v = number(self.column)
        if self.kind == "sum":
            s = F.coalesce(total(list(self.columns)), F.lit(0.0))
            out = [s < self.low] * (self.low is not None) + [s > self.high] * (self.high is not None)
        elif self.kind == "range":
            out = [v < self.low] * (self.low is not None) + [v > self.high] * (self.high is not None)
        elif self.kind in ("positive", "non-negative"):
            out = [v <= 0 if self.kind == "positive" else v < 0]
        elif self.kind == "custom" and self.condition is not None:
            out = [~self.condition]
        else:
            raise ValueError(f"unknown rule {self.kind}")
        return v.isNotNull() & F.coalesce(reduce(lambda a, b: a | b, out, F.lit(False)), F.lit(False))


def violations(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(key, rule, severity, value): one row for each rule that a row breaks; all rules in one scan."""
    told = [F.when(r.broken(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), number(r.column).alias("value"))) for r in rules]
    if not told:
        return df.select(*key, F.lit("").alias("rule"), F.lit("").alias("severity"), F.lit(0.0).alias("value")).limit(0)
    return df.select(*key, F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("__v")).select(*key, "__v.*")


def rule_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, broken, valid): rows that break each rule, and whether the table passes it (warnings never fail it)."""
    counts = df.agg(*[F.count(F.when(r.broken(), 1)).alias(f"c{k}") for k, r in enumerate(rules)])
    cells = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"c{k}").alias("broken"), ((F.col(f"c{k}") == 0) | F.lit(r.severity != "error")).alias("valid")) for k, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*cells)))


def oxide_column(columns: list[str], oxide: str) -> str | None:
    """The column that holds an oxide: its name, a usual variant, the same in any case, else the first that starts with it."""
    for name in (oxide, oxide.lower(), oxide.upper(), f"{oxide}_pct", f"{oxide}_wt", f"{oxide}_%", f"{oxide.lower()}_pct"):
        if name in columns:
            return name
    return next((c for c in columns if c.lower().startswith(oxide.lower())), None)


def major_sum(df: DataFrame) -> DataFrame:
    """``df`` with ``major_sum`` of the oxides that it holds and ``major_status``: ok, below 95 or above 105 percent."""
    held = [c for c in (oxide_column(df.columns, o) for o in MAJOR_OXIDES) if c]
    s = F.coalesce(total(held), F.lit(0.0)) if held else F.lit(0.0)
    return df.withColumns({"major_sum": s, "major_status": F.when(s < LEAST_SUM, "below").when(s > MOST_SUM, "above").otherwise("ok")})


def unit_guess(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, max, mean, unit): weight percent, parts per million or per billion by the size of the values; null without values."""
    row = df.agg(*[f for c in columns for f in (F.max(number(c)), F.avg(number(c)))]).first()
    out = []
    for k, c in enumerate(columns):
        most, mean = row[2 * k], row[2 * k + 1]
        unit = None if most is None else "wt%" if most <= 100 and mean <= 50 else "ppm" if most <= 1e5 and mean <= 1e4 else "ppb" if most > 1e5 else "ppm"
        out.append((c, most, mean, unit))
    return df.sparkSession.createDataFrame(out, "column string, max double, mean double, unit string")


def box_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, n, low, q1, median, q3, high, whisker_low, whisker_high, outliers) with quartiles of floor rank and fences at 1.5 of their range.

    Whiskers are the farthest values inside the fences; groups without values have no row.
    """
    told = quantiles(complete(df, [column]), {"__q": column}, [0.25, 0.5, 0.75], by, floor=True)
    told = told.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col("__q")[k].alias(c) for k, c in enumerate(("q1", "median", "q3"))])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    v, reach = F.col("__v"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    rows = complete(df, [column]).select(*by, F.col(column).cast("double").alias("__v")).join(told, same)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(v).alias("low"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.max(v).alias("high"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outliers"),
    )


def indicator_histogram(df: DataFrame, column: str, bands: list[tuple[float, str]] = ()) -> DataFrame:
    """(bin, start, end, n, band): min(30, ceil(root n)) bins, the last a little wider, with the highest band that the bin's middle reaches."""
    rows = complete(df, [column]).select(F.col(column).cast("double").alias("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    table = "bin int, start double, end double, n long, band string"
    if not n:
        return df.sparkSession.createDataFrame([], table)
    bins = min(30, math.ceil(math.sqrt(n)))
    width = (high - low) / bins or 1.0
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width)))
    counts = {r[0]: r[1] for r in rows.groupBy(at.alias("b")).count().collect()}
    out = []
    for k in range(bins):
        start, end = low + k * width, high + 0.001 if k == bins - 1 else low + (k + 1) * width
        reached = [name for bound, name in sorted(bands) if (start + end) / 2 >= bound]
        out.append((k, start, end, counts.get(k, 0), reached[-1] if reached else None))
    return df.sparkSession.createDataFrame(out, table)


def caption(df: DataFrame, column: str) -> DataFrame:
    """(n, mean, median): the mean and the upper median of a column."""
    rows = complete(df, [column]).select(F.col(column).cast("double").alias("v"))
    n = rows.count()
    middle = quantiles(rows, {"q": "v"}, [min(1.0, (n // 2) / max(1, n - 1))])
    return rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).join(middle).select("n", "mean", F.col("q")[0].alias("median"))
