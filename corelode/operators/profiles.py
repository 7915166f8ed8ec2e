"""Profiles of columns, roles, ranks, hole summaries and places: what a table is looked at by."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.functions import chemistry
from corelode.operators import drill
from corelode.operators.frames import complete
from corelode.sources.tables import column_roles

#: Texts that stand for no number in a loose reading.
_NO_NUMBER = ("NA", "N/A", "NULL", "-", "--", "")


def column_profile(df: DataFrame) -> DataFrame:
    """(place, column, type, known, missing, distinct, role) of every column, from one scan; ``distinct`` is estimated, ``known`` leaves out blank texts."""
    text = {c for c, t in df.dtypes if t == "string"}
    held = lambda c: F.nullif(F.trim(f"`{c}`"), F.lit("")) if c in text else F.col(f"`{c}`")
    row = df.agg(F.count("*"), *[f for c in df.columns for f in (F.count(held(c)), F.approx_count_distinct(held(c)))]).first()
    roles = column_roles(df.columns)
    out = [(k, c, t, row[1 + 2 * k], row[0] - row[1 + 2 * k], row[2 + 2 * k], roles.get(c)) for k, (c, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(out, "place int, column string, type string, known long, missing long, distinct long, role string")


def best_roles(profile: DataFrame, confidence: dict[str, float] | None = None) -> DataFrame:
    """(role, column, score): for each role the column of the best score, if that is 50 or more; the earlier of equals.

    A score is the confidence of the role (90 if not told; under 50 does not count), times the share of known rows (a half at least), times 1 less a hundredth
    for each place.
    """
    sure = F.lit(90.0)
    for column, c in (confidence or {}).items():
        sure = F.when(F.col("column") == column, float(c)).otherwise(sure)
    rows = profile.where("role is not null").withColumn("sure", sure).where("sure >= 50")
    share = F.greatest(F.lit(0.5), F.try_divide(F.col("known"), F.greatest(F.col("known") + F.col("missing"), F.lit(1))))
    told = rows.withColumn("score", F.col("sure") * share * (1 - 0.01 * F.col("place")))
    best = told.groupBy("role").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "column")).alias("b"))
    return best.where("b.score >= 50").select("role", F.col("b.column").alias("column"), F.col("b.score").alias("score"))


def loose_number(text: Column) -> Column:
    """A number from a text: commas, blanks and a leading ``<`` or ``>`` are dropped; null for markers and all else."""
    t = F.regexp_replace(F.trim(text), "[, ]", "")
    return F.when(~F.upper(F.trim(text)).isin(*_NO_NUMBER), F.regexp_replace(t, "^[<>]", "").try_cast("double"))


def linear_rank(df: DataFrame, column: str, low: float | None = None, high: float | None = None, name: str = "rank") -> DataFrame:
    """``df`` with where a value lies between two bounds (by default the column's), from 0 to 1; 0.5 where they are equal, null without a value."""
    v = F.col(column).cast("double")
    known = F.when(~F.isnan(v), v)
    box = df.agg(F.min(known).alias("__lo"), F.max(known).alias("__hi"))
    lo, hi = F.col("__lo") if low is None else F.lit(low), F.col("__hi") if high is None else F.lit(high)
    share = F.when(hi == lo, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(known - lo, hi - lo))))
    return df.join(box).withColumn(name, F.when(known.isNotNull(), share)).drop("__lo", "__hi")


def range_rank(value: Column, ranges: list[tuple[float | None, float | None]]) -> Column:
    """Rank from 0 to 1 of the first range that holds a value: half open, null ends are open; 1 beyond the last, else 0; null without a value."""
    out, last = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("double")), max(1, len(ranges) - 1)
    for k, (low, high) in enumerate(ranges):
        inside = (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value < high)
        out = out.when(inside, k / last)
    top = ranges[-1][1] if ranges else None
    return (out.when(value >= top, 1.0) if top is not None else out).otherwise(0.0)


def category_rank(value: Column, categories: list[str]) -> Column:
    """Rank from 0 to 1 of a category in a list, 0.5 for others; null without a value."""
    out, last = F.when(value.isNull(), F.lit(None).cast("double")), max(1, len(categories) - 1)
    for k, c in enumerate(categories):
        out = out.when(value.cast("string") == c, k / last)
    return out.otherwise(0.5)


def match_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """(hole, assays, matched, low, match_pct, avg_overlap_pct, gaps, overlaps) of each hole with assays.

    left: hole, row_id, from, to; right: hole, log_id, from, to, category.  A row is matched by its largest overlap, low under 50 percent; gaps and overlaps are
    those of the logs.  Percentages have one digit, halves to even.  Equal intervals of a hole match alike: they meet once, by depth buckets, and are counted,
    so the work follows a hole's different intervals and not its pairs of rows.
    """
    rows = left.groupBy("hole", "from", "to").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))
    logs = right.groupBy("hole", "from", "to").agg(F.max(F.struct((-F.col("log_id")).alias("o"), "category")).alias("l"))
    logs = logs.select("hole", (-F.col("l.o")).alias("log_id"), "from", "to", F.col("l.category").alias("category"))
    hit = F.col("pct") > 0
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    told = drill.max_overlap(rows, logs, deep=True).groupBy("hole").agg(
        F.sum("n").alias("assays"), count(hit).alias("matched"), count(hit & (F.col("pct") < 50)).alias("low"), (F.sum(F.when(hit, F.col("pct") * F.col("n"))) / count(hit)).alias("mean")
    )
    logs = drill.gaps_and_overlaps(right, ["log_id"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return told.join(logs, "hole", "left").select(
        "hole", "assays", "matched", "low", F.bround(100 * F.col("matched") / F.col("assays"), 1).alias("match_pct"), F.bround(F.coalesce("mean", F.lit(0.0)), 1).alias("avg_overlap_pct"),
        zero("gaps").alias("gaps"), zero("overlaps").alias("overlaps"),
    )


def downhole_profile(df: DataFrame, hole: str, depth: str, values: list[str]) -> DataFrame:
    """(hole, depth, values, thickness, running mean of the first value over three): known depths of each hole, in order.

    One window by hole: a hole's rows are sorted in one task, however many holes there are.
    """
    own = Window.partitionBy(hole).orderBy(depth, *values)
    rows = complete(df, [depth]).select(hole, depth, *values)
    after = F.lead(depth).over(own)
    return rows.withColumns({"thickness": after - F.col(depth), "smooth": F.avg(values[0]).over(own.rowsBetween(-1, 1))})


def ratio_ranking(df: DataFrame, parts: list[str], group: str | None = None, top: int | None = None) -> DataFrame:
    """(ratio, variance, contributed, explained[, between]) of all log-ratios by falling variance, the ``top`` first.

    ``contributed``: percent of the sum of variances; ``explained``: percent of R2 with the sum of the other ratios; ``between``: percent of the squares about the mean that lie
    between groups.  Rows with a part that is not positive are left out; everything comes from one aggregation, and one more by group.
    """
    rows = df
    for c in parts:
        v = F.col(c).cast("double")
        rows = rows.where((v > 0) & ~F.isnan(v) & (v != float("inf")))
    pairs = list(combinations(parts, 2))
    logs = [F.ln(a) - F.ln(b) for a, b in pairs]
    every = sum(logs[1:], logs[0])
    keep = [group] if group else []
    rows = rows.select(*keep, *[x.alias(f"r{k}") for k, x in enumerate(logs)], every.alias("every"))
    r = [F.col(f"r{k}") for k in range(len(pairs))]
    others = [F.col("every") - x for x in r]
    cells = [F.struct(F.var_samp(x).alias("v"), F.coalesce(F.try_divide(F.covar_pop(x, o) * F.covar_pop(x, o), F.var_pop(x) * F.var_pop(o)), F.lit(0.0)).alias("e")) for x, o in zip(r, others, strict=True)]
    told = rows.agg(F.array(*cells).alias("c"))
    if group:
        means = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{k}") for k, x in enumerate(r)])
        spread = lambda k: F.sum(F.col("n") * F.col(f"m{k}") ** 2) - F.sum(F.col("n") * F.col(f"m{k}")) ** 2 / F.sum("n")
        inside = rows.agg(*[(F.var_pop(x) * F.count("*")).alias(f"t{k}") for k, x in enumerate(r)])
        told = told.join(means.agg(*[spread(k).alias(f"b{k}") for k in range(len(pairs))])).join(inside)
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + F.coalesce(x["v"], F.lit(0.0)))
    out = []
    for k, (a, b) in enumerate(pairs):
        more = [(100 * F.try_divide(F.col(f"b{k}"), F.col(f"t{k}"))).alias("between")] if group else []
        out.append(F.struct(F.lit(f"{a}/{b}").alias("ratio"), F.col("c")[k]["v"].alias("variance"), (100 * F.try_divide(F.col("c")[k]["v"], total)).alias("contributed"), (100 * F.col("c")[k]["e"]).alias("explained"), *more))
    ranked = told.select(F.inline(F.array(*out))).orderBy(F.desc("variance"), "ratio")
    return ranked if top is None else ranked.limit(top)


def spider_rows(df: DataFrame, key: list[str], columns: dict[str, str], standard: str | None = None) -> DataFrame:
    """(key, place, element, value): one row for each element, in the order told, over the standard's value where it has one; missing values stay null."""
    table = chemistry.STANDARDS[standard] if standard else {}
    cells = []
    for k, (element, column) in enumerate(columns.items()):
        v = F.col(column).cast("double")
        v = F.when(~F.isnan(v), v)
        norm = table.get(element)
        cells.append(F.struct(F.lit(k).alias("place"), F.lit(element).alias("element"), (v / F.lit(float(norm)) if norm else v).alias("value")))
    return df.select(*key, F.explode(F.array(*cells)).alias("__c")).select(*key, "__c.*")


def extent(df: DataFrame, x: str, y: str, buffer: float = 0.05) -> DataFrame:
    """(n, x0, y0, x1, y1, cx, cy): the box around the places, wider by a share of its sides, and their mean; nulls without places."""
    rows = complete(df, [x, y]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    box = rows.agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    wide, high = buffer * (F.col("b") - F.col("a")), buffer * (F.col("d") - F.col("c"))
    return box.select("n", (F.col("a") - wide).alias("x0"), (F.col("c") - high).alias("y0"), (F.col("b") + wide).alias("x1"), (F.col("d") + high).alias("y1"), "cx", "cy")


def inside_extent(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose place lies in a box (x0, y0, x1, y1), its sides among it."""
    return df.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def plot_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high, low_positive) of each column's finite values, in one aggregation."""
    cells = []
    for c in columns:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        cells.append(F.struct(F.lit(c).alias("column"), F.min(v).alias("low"), F.max(v).alias("high"), F.min(F.when(v > 0, v)).alias("low_positive")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def sample_size(rows: int) -> int | None:
    """Rows that a sample of a large table takes: a quarter, 10,000 at most; None up to 20,000 rows."""
    return min(10_000, rows // 4) if rows > 20_000 else None
