"""Grids, polygons, class breaks and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.operators.frames import complete
from corelode.operators.ordering import quantiles


#: Strata whose sizes are taken to the driver.
MOST_STRATA = 10_000
#: Grids of so many cells a side are sent to all tasks: 9 rows a node, under 20 MB.
MOST_BROADCAST_CELLS = 150


def inside(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Whether (x, y) is inside a polygon, by an odd number of edges crossed to its right."""
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True):
        if yi != yj:
            spans = (F.lit(yi) > y) != (F.lit(yj) > y)
            crossings = crossings + F.when(spans & (x < (xj - xi) * (y - yi) / (yj - yi) + xi), 1).otherwise(0)
    return crossings % 2 == 1


def classify_points(df: DataFrame, x: str, y: str, polygons: list[tuple[str, list[tuple[float, float]]]]) -> DataFrame:
    """``df`` with the name of the first polygon that holds each point, else Unclassified."""
    found = F.when(F.col(x).isNull() | F.col(y).isNull(), "Unclassified")
    for name, points in polygons:
        found = found.when(inside(F.col(x), F.col(y), points), name)
    return df.withColumn("polygon", found.otherwise("Unclassified"))


def idw_grid(points: DataFrame, x: str, y: str, value: str, cells: int, radius: float, power: float = 1.5) -> DataFrame:
    """(col, row, z): inverse-distance means at the cells x cells nodes over the points' extent.

    Points reach nodes through buckets as wide as the radius, so no pair farther than two buckets apart is formed.
    """
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    spark = points.sparkSession
    nodes = spark.range(cells * cells).select((F.col("id") % cells).alias("col"), F.floor(F.col("id") / cells).alias("row")).join(F.broadcast(box))
    nodes = nodes.select(
        "col", "row", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("col") / max(cells - 1, 1)).alias("nx"), (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("row") / max(cells - 1, 1)).alias("ny")
    )
    bucket = lambda c: F.floor(F.col(c) / radius)
    near = F.sequence(F.lit(-1), F.lit(1))
    nodes = nodes.withColumn("bx", bucket("nx")).withColumn("by", bucket("ny"))
    spread = points.where(f"{x} is not null and {y} is not null and {value} is not null").select(F.col(x).alias("px"), F.col(y).alias("py"), F.col(value).alias("v"))
    # Equal places are summed first, so that a crowded place counts as one row.
    spread = spread.groupBy("px", "py").agg(F.sum("v").alias("sv"), F.count("*").alias("k"))
    # Nodes are few and known in number: they, not the points, are repeated for the buckets around.
    nodes = nodes.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    nodes = nodes.withColumn("bx", F.col("bx") + F.col("dx")).withColumn("by", F.col("by") + F.col("dy"))
    spread = spread.withColumn("bx", bucket("px")).withColumn("by", bucket("py"))
    pairs = spread.join(F.broadcast(nodes) if cells <= MOST_BROADCAST_CELLS else nodes, ["bx", "by"])
    d2 = (F.col("nx") - F.col("px")) ** 2 + (F.col("ny") - F.col("py")) ** 2
    pairs = pairs.withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    weight = 1 / F.pow(F.greatest(F.col("d2"), F.lit(1e-10)), power / 2)
    return pairs.groupBy("col", "row").agg((F.sum(weight * F.col("sv")) / F.sum(weight * F.col("k"))).alias("z"), F.sum("k").alias("n"))


def _share(c: str, low: str, high: str) -> Column:
    """Where a value lies between two others, from 0 to 1; 0 where they are equal."""
    return F.coalesce(F.try_divide(F.col(c) - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))


def density_grid(points: DataFrame, x: str, y: str, cells: int) -> DataFrame:
    """(col, row, n, density): counts of an equal-width grid and their log1p; points without finite coordinates are left out."""
    points = complete(points, [x, y])
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = lambda c, a, b: F.least(F.lit(cells - 1), F.floor(_share(c, a, b) * cells))
    return points.join(F.broadcast(box)).groupBy(at(x, "x0", "x1").alias("col"), at(y, "y0", "y1").alias("row")).agg(F.count("*").alias("n"), F.log1p(F.count("*")).alias("density"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over equal bins from the least to the largest value; the last bin is closed."""
    df = complete(df, [column])
    box = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    k = F.least(F.lit(bins - 1), F.floor(_share(column, "lo", "hi") * bins))
    return df.join(F.broadcast(box)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def quantile_classes(df: DataFrame, column: str, classes: int) -> DataFrame:
    """``df`` with the class (from 0) of each value between linear percentile breaks; half-open, the last closed."""
    q = quantiles(df, {"breaks": column}, [k / classes for k in range(1, classes)])
    at = F.size(F.filter("breaks", lambda b: F.col(column) >= b))
    return df.join(F.broadcast(q)).withColumn("class", F.when(F.col(column).isNotNull(), at)).drop("breaks")


def _chance(key: list[str]) -> Column:
    """A number from 0 to 1 that the key decides."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key])), 1, 8), 16, 10).cast("long") / float(1 << 32)


def representative_sample(df: DataFrame, columns: list[str], key: list[str], size: int, stratum: str | None = None, k: float = 1.5, by_hole: bool = False) -> DataFrame:
    """``size`` rows: those outside k interquartile ranges of any column first, then others, chosen by a hash of the key.

    Where the outliers alone fill the sample, it is taken from them.  With a stratum the rest is shared in proportion
    to its classes (null is one), rounded, at least one each, and trimmed.  ``by_hole`` takes whole strata in hash order until the next would overflow
    (one at least).  A table of no more than ``size`` rows comes whole.  Only rows whose hash can still be chosen are sorted.
    """
    # Two numbers a column, and the sizes of few strata, are taken once; the table is then read again only to choose.
    quarters = quantiles(df, {c: c for c in columns}, [0.25, 0.75]).first()
    out = F.lit(False)
    for c in columns:
        if quarters is not None and quarters[c]:
            lo, hi = quarters[c]
            out = out | F.coalesce((F.col(c) < F.lit(lo - k * (hi - lo))) | (F.col(c) > F.lit(hi + k * (hi - lo))), F.lit(False))
    marked = df.withColumn("outlier", out).withColumn("__h", _chance(key))
    group = F.col(stratum) if stratum else F.lit(0)
    sizes = marked.groupBy(group.alias("__g")).agg(F.count(F.when(F.col("outlier"), 1)).alias("odd"), F.count("*").alias("many"))
    few = sizes.limit(MOST_STRATA + 1).collect()
    if len(few) <= MOST_STRATA:
        total = (sum(r["odd"] for r in few), sum(r["many"] for r in few))
        sizes = df.sparkSession.createDataFrame(few, sizes.schema)
    else:
        total = sizes.agg(F.sum("odd"), F.sum("many")).first()
    odd, rest = int(total[0]), int(total[1]) - int(total[0])
    if odd + rest <= size:
        return marked.select(*df.columns, "outlier")

    def first(rows: DataFrame, wanted: Column, many: Column, by: list[str]) -> DataFrame:
        """The ``wanted`` rows of lowest hash of each group of ``many``."""
        near = rows.where(F.col("__h") <= 2 * wanted / many + 100 / many)
        turn = F.row_number().over(Window.partitionBy(*by).orderBy("__h", *key))
        return near.withColumn("__turn", turn).where(F.col("__turn") <= wanted).drop("__turn")

    outliers, others = marked.where("outlier"), marked.where("not outlier")
    if odd >= size:
        return first(outliers.withColumn("__one", F.lit(0)), F.lit(size), F.lit(odd), ["__one"]).select(*df.columns, "outlier")
    left = size - odd
    if by_hole:
        holes = sizes.select("__g", (F.col("many") - F.col("odd")).alias("n")).where("n > 0").withColumn("__h", _chance(["__g"]))
        run = F.sum("n").over(Window.orderBy("__h", "__g").rowsBetween(Window.unboundedPreceding, 0))
        some = holes.where(F.col("__h") <= 2 * left / rest + 100 * F.lit(1.0) / F.greatest(F.lit(1.0), F.lit(float(sizes.count()))))
        some = some.withColumn("run", run).withColumn("turn", F.row_number().over(Window.orderBy("__h", "__g"))).where((F.col("run") <= left) | (F.col("turn") == 1))
        chosen = others.join(some.select("__g"), group.eqNullSafe(F.col("__g")), "left_semi")
    else:
        share = F.least(F.greatest(F.lit(1), F.bround((F.col("many") - F.col("odd")) * left / rest)), F.col("many") - F.col("odd")).cast("long")
        told = sizes.where("many > odd").select("__g", share.alias("__share"), (F.col("many") - F.col("odd")).alias("__n"))
        chosen = first(others.join(told, group.eqNullSafe(F.col("__g"))), F.col("__share"), F.col("__n"), ["__g"])
        # Rounding may take some too many: those of the highest hash go.
        turn = F.row_number().over(Window.orderBy("__h", *key))
        chosen = chosen.withColumn("__turn", turn).where(F.col("__turn") <= left)
    return outliers.select(*df.columns, "outlier").union(chosen.select(*df.columns, "outlier"))


#: Height of a triangle of side one.
TRIANGLE = 3**0.5 / 2


def ternary_to_plane(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """(x, y) of three parts in a triangle of side one: b at the left, c at the right, a on top; its middle where they sum to 0."""
    total = a + b + c
    share = lambda p: F.try_divide(p, total)
    return F.coalesce(0.5 * (2 * share(c) + share(a)), F.when(total == 0, 0.5)), F.coalesce(TRIANGLE * share(a), F.when(total == 0, 0.289))


def plane_to_ternary(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Percentages (a, b, c) of a place in a triangle of side one; at the top b and c are 0."""
    a = y / TRIANGLE
    rest = 1 - a
    c = F.when(rest > 1e-5, x - 0.5 * a).otherwise(0.0)
    return 100 * a, F.when(rest > 1e-5, 100 * (rest - c)).otherwise(0.0), 100 * c


def polygon_measures(corners: DataFrame, key: list[str], order: str, x: str, y: str) -> DataFrame:
    """(key, corners, area, cx, cy): area and centroid of each polygon from its corners in ``order``; corners' mean where the area vanishes."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    told = corners.groupBy(*key).agg(listed.alias("p"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    after = F.concat(F.slice("p", 2, F.greatest(F.lit(1), F.size("p") - 1)), F.slice("p", 1, 1))
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    edges = F.zip_with("p", after, lambda p, q: F.struct(cross(p, q).alias("w"), ((p["x"] + q["x"]) * cross(p, q)).alias("u"), ((p["y"] + q["y"]) * cross(p, q)).alias("v")))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    sums = F.aggregate(edges, zero, lambda s, e: F.struct((s["w"] + F.coalesce(e["w"], F.lit(0.0))).alias("w"), (s["u"] + F.coalesce(e["u"], F.lit(0.0))).alias("u"), (s["v"] + F.coalesce(e["v"], F.lit(0.0))).alias("v")))
    done = told.withColumn("s", sums)
    flat = F.abs("s.w") < 2e-4
    at = lambda c, mean: F.when(flat, F.col(mean)).otherwise(F.try_divide(F.col(f"s.{c}"), 3 * F.col("s.w")))
    return done.select(*key, F.size("p").alias("corners"), (F.abs("s.w") / 2).alias("area"), at("u", "mx").alias("cx"), at("v", "my").alias("cy"))
