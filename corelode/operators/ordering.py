"""Ranks and quantiles over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one part of a ranking should hold, and the most parts.
PART_ROWS, MOST_PARTS = 1_000_000, 512
#: Rows up to which a percentile is taken in one aggregation.
EXACT_ROWS = 1_000_000


def _part_of(value: Column, bounds: list, low: int = 0, high: int | None = None) -> Column:
    """Number of ``bounds`` (rising) that are not above the value, as nested comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value < F.lit(bounds[mid]), _part_of(value, bounds, low, mid)).otherwise(_part_of(value, bounds, mid + 1, high))


def cut_points(df: DataFrame, column: str) -> list:
    """Rising values of ``column`` that cut it into parts of about PART_ROWS rows; a bounded number."""
    n = df.where(F.col(column).isNotNull()).count()
    parts = min(MOST_PARTS, -(-n // PART_ROWS))
    if parts < 2:
        return []
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    return sorted(set(df.agg(F.percentile_approx(column, shares, F.lit(10 * parts)).alias("p")).first()["p"]))


def ranked(df: DataFrame, column: str, order: list[str], name: str) -> DataFrame:
    """``df`` with its rank from 1 in ``order``, whose first column is the numeric ``column``.

    Parts by value are sorted each in a task of its own and start after all rows of the parts before.
    Null values come first, in the first part.
    """
    part = F.coalesce(_part_of(F.col(column), cut_points(df, column)), F.lit(0))
    dealt = df.withColumn("__part", F.when(F.col(column).isNull(), 0).otherwise(part))
    sizes = dealt.groupBy("__part").count()
    # One row for each part.
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    turn = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(sizes, "__part").withColumn(name, F.col("__before") + turn).drop("__part", "__before")


#: Half width of a bracket as a share of the rows; the sketch that sets it is four times as sharp.
SLACK, SHARPNESS = 4 / 10_000, 10_000
#: Groups of fewer rows keep all their values: a bracket must reach some rows beyond its rank.
SMALL_GROUP = 10_000
#: Rows of group statistics that are taken once and sent to all tasks at most.
MOST_HELD = 100_000


def held(stats: DataFrame) -> DataFrame:
    """Group statistics, worked out once and sent to all tasks; as they are where they have over MOST_HELD rows.

    A join with them then deals no rows by group: a few groups would else be a few tasks.
    """
    rows = stats.limit(MOST_HELD + 1).collect()
    return stats if len(rows) > MOST_HELD else F.broadcast(stats.sparkSession.createDataFrame(rows, stats.schema))


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    """Whether the keys are equal, nulls too; those of the right side are named with ``__by_``."""
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(right[f"__by_{c}"])
    return same


def _bracketed(df: DataFrame, columns: dict[str, str], shares: list[float], by: list[str], floor: bool = False) -> DataFrame:
    """(by, name, q) of the exact percentiles, linear or of rank floor(n share), q null without values: a sketch brackets every rank, one more scan counts what lies between and inside.

    Both scans take all columns, shares and groups at once.  Only values inside a bracket, about SLACK of the rows on either side of a rank, are
    kept one by one, with counts; what lies between two brackets is one count.
    """
    cells = df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("__name"), F.col(c).cast("double").alias("__v")) for n, c in columns.items()])).alias("__c"))
    cells = cells.select(*by, "__c.__name", F.when(~F.isnan("__c.__v"), F.col("__c.__v")).alias("__v"))
    ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-SLACK, SLACK)]
    sizes = cells.groupBy(*by, "__name").agg(F.count("__v").alias("__n"), F.percentile_approx("__v", F.array(*map(F.lit, ends)), F.lit(SHARPNESS)).alias("__e"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    small = F.col("__n") < SMALL_GROUP
    low = lambda k: F.col("__lo") if ends[2 * k] == 0 else F.when(small, F.col("__lo")).otherwise(F.col("__e")[2 * k])
    high = lambda k: F.col("__hi") if ends[2 * k + 1] == 1 else F.when(small, F.col("__hi")).otherwise(F.col("__e")[2 * k + 1])
    bounds = [c for k in range(len(shares)) for c in (low(k).alias(f"__low{k}"), high(k).alias(f"__high{k}"))]
    sizes = held(sizes.select(*[F.col(c).alias(f"__by_{c}") for c in [*by, "__name"]], "__n", *bounds))
    over = sum(((F.col("__v") >= F.col(f"__low{k}")).cast("int") for k in range(len(shares))), F.lit(0))
    past = sum(((F.col("__v") > F.col(f"__high{k}")).cast("int") for k in range(len(shares))), F.lit(0))
    # Both numbers rise with the value: equal sums mean the same stretch, inside or between brackets.
    met = cells.where("__v is not null").join(sizes, _same(cells, sizes, [*by, "__name"])).select(*by, "__name", "__n", (over + past).alias("__at"), F.when(over > past, F.col("__v")).alias("__v"))
    counts = met.groupBy(*by, "__name", "__n", "__at", "__v").agg(F.count("*").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*by, "__name").orderBy("__at", "__v"))
    at = lambda r: F.min(F.when(F.col("__upto") > r, F.struct("__at", "__v")))["__v"]
    rank_of = lambda s: F.least(F.floor(F.col("__n") * F.lit(s)), F.col("__n") - 1).cast("double") if floor else (F.col("__n") - 1) * F.lit(s)
    told = []
    for s in shares:
        rank = rank_of(s)
        told.append(F.struct(at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b")))
    found = counts.withColumn("__upto", upto).groupBy(*by, "__name", "__n").agg(*[x.alias(f"__r{k}") for k, x in enumerate(told)])
    part = lambda s: rank_of(s) - F.floor(rank_of(s))
    values = [F.col(f"__r{k}.a") + part(s) * (F.col(f"__r{k}.b") - F.col(f"__r{k}.a")) for k, s in enumerate(shares)]
    found = found.select(*[F.col(c).alias(f"__of_{c}") for c in [*by, "__name"]], F.array(*values).alias("__q"))
    whole = F.lit(True)
    for c in [*by, "__name"]:
        whole = whole & F.col(f"__by_{c}").eqNullSafe(F.col(f"__of_{c}"))
    return sizes.join(found, whole, "left").select(*[F.col(f"__by_{c}").alias(c) for c in [*by, "__name"]], "__q")


def quantiles(df: DataFrame, columns: dict[str, str], shares: list[float], by: list[str] = (), rows: int | None = None, floor: bool = False) -> DataFrame:
    """One row, or one for each group: for each name an array of the exact linear percentiles of its column, null without values.

    With ``floor`` they are the values of rank floor(n share), counted from 0.

    Small tables take one aggregation.  Beyond EXACT_ROWS, where it would hold all distinct values of a group in one
    task, ranks are bracketed first.  A null group is a group.  Up to MOST_HELD rows of the result are worked out at once.
    ``rows``, where it is known, saves counting the table.
    """
    by = list(by)
    if not floor and (df.count() if rows is None else rows) <= EXACT_ROWS:
        v = {n: F.col(c).cast("double") for n, c in columns.items()}
        return held(df.groupBy(*by).agg(*[F.percentile(F.when(~F.isnan(c), c), F.array(*map(F.lit, shares))).alias(n) for n, c in v.items()]))
    found = _bracketed(df, columns, shares, by, floor)
    return held(found.groupBy(*by).agg(*[F.first(F.when(F.col("__name") == n, F.col("__q")), ignorenulls=True).alias(n) for n in columns]))


def equal_bins(df: DataFrame, m: str, d: str, size) -> DataFrame:
    """(bin, low, high, sum_m, sum_d2, pairs): rows by rising ``m``, then ``d`` (no nulls), cut into bins of ``size(rows)`` rows.

    No row is ranked that lies between the cuts: a sketch brackets each cut, what lies between two brackets is summed up whole, and only rows inside
    a bracket are counted by value and dealt to either side.  Up to EXACT_ROWS rows are one bracket.  ``df`` is read three times.
    """
    n = df.count()
    each = int(size(n))
    cuts = list(range(each, n, each))
    v = F.col(m)
    if n <= EXACT_ROWS:
        brackets = [tuple(df.agg(F.min(m), F.max(m)).first())] if n else []
    else:
        ends = [min(1.0, max(0.0, c / n + e)) for c in cuts for e in (-SLACK, SLACK)]
        told = df.agg(F.percentile_approx(v, F.array(*map(F.lit, ends)), F.lit(SHARPNESS)).alias("e"), F.min(m).alias("a"), F.max(m).alias("b")).first()
        edges = [told["a"] if e == 0 else told["b"] if e == 1 else x for e, x in zip(ends, told["e"] or [], strict=True)]
        brackets = list(zip(edges[::2], edges[1::2], strict=True))
    over = sum(((v >= F.lit(a)).cast("int") for a, _ in brackets), F.lit(0))
    past = sum(((v > F.lit(b)).cast("int") for _, b in brackets), F.lit(0))
    # Both numbers rise with the value: equal sums mean the same stretch, inside or between brackets.
    met = df.select(v.alias("m"), F.col(d).alias("d"), (over + past).alias("at"), (over > past).alias("inside"))
    met = met.select("m", "d", "at", *[F.when(F.col("inside"), F.col(c)).alias(f"own_{c}") for c in "md"])
    counts = met.groupBy("at", "own_m", "own_d").agg(F.count("*").alias("c"), F.min("m").alias("low"), F.max("m").alias("high"), F.sum("m").alias("sm"), F.sum("d").alias("sd"))
    sizes = counts.groupBy("at").agg(F.sum("c").alias("__many"))
    # One row for each stretch, of which there are two for each cut at most.
    before = F.coalesce(F.sum("__many").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("c").over(Window.partitionBy("at").orderBy("own_m", "own_d").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("upto", upto).join(F.broadcast(sizes.select("at", before.alias("before"))), "at")
    first, last = F.col("before") + F.col("upto") - F.col("c"), F.col("before") + F.col("upto")
    bin_of = lambda rank: F.floor(rank / each)
    dealt = ranks.select("*", first.alias("first"), last.alias("last"), F.explode(F.sequence(bin_of(first), bin_of(last - 1))).alias("bin"))
    part = F.least(F.col("last"), (F.col("bin") + 1) * each) - F.greatest(F.col("first"), F.col("bin") * each)
    whole = part == F.col("c")
    return dealt.groupBy("bin").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.when(whole, F.col("sm")).otherwise(F.col("own_m") * part)).alias("sum_m"),
        F.sum(F.when(whole, F.col("sd")).otherwise(F.col("own_d") * part)).alias("sum_d2"), F.sum(part).alias("pairs"),
    )


def smallest(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """Rows up to the one of rank ``rows`` of ``total`` known values of a column, smallest first; equal values at the end stay together."""
    cut = quantiles(df, {"__cut": column}, [(rows - 1) / max(1, total - 1)]).select((F.col("__cut")[0] + 1e-9 * F.abs(F.col("__cut")[0])).alias("__cut"))
    return df.join(cut).where(F.col(column) <= F.col("__cut")).drop("__cut")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the average rank from 1 of ``column``, ties averaged: counts by value, then ranks of the distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    part = _part_of(F.col(column), cut_points(df, column))
    dealt = counts.withColumn("__part", part)
    sizes = dealt.groupBy("__part").agg(F.sum("count").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    below = F.sum("count").over(Window.partitionBy("__part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    table = dealt.join(sizes, "__part").select(column, (F.col("__before") + below - (F.col("count") - 1) / 2).alias(name))
    return df.join(table, column, "left")
