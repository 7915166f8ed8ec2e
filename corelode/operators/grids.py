"""Work on regular grids (col, row, z): Gaussian smoothing, fading away from data, anisotropic kernel density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete

#: Widest smoothing kernel, in cells from its centre.
MOST_RADIUS = 30


def _spread(cells: DataFrame, offsets: Column, columns: int, rows: int) -> DataFrame:
    """(col, row, z, w): each cell told to its neighbours, by offsets of (dc, dr, w), inside the grid."""
    told = cells.select("col", "row", "z", F.explode(offsets).alias("o"))
    told = told.select((F.col("col") + F.col("o.dc")).alias("col"), (F.col("row") + F.col("o.dr")).alias("row"), "z", F.col("o.w").alias("w"))
    return told.where(F.col("col").between(0, columns - 1) & F.col("row").between(0, rows - 1))


def _offsets(kernel: list[tuple[int, int, float]]) -> Column:
    """A bounded kernel as one array."""
    return F.array(*[F.struct(F.lit(c).alias("dc"), F.lit(r).alias("dr"), F.lit(float(w)).alias("w")) for c, r, w in kernel])


def gaussian_kernel(sigma: float) -> list[tuple[int, int, float]]:
    """(dc, dr, weight) within three deviations, MOST_RADIUS cells at most, of sum one."""
    radius = min(math.ceil(3 * sigma), MOST_RADIUS)
    cells = [(c, r, math.exp(-(c * c + r * r) / (2 * sigma * sigma))) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if c * c + r * r <= 9 * sigma * sigma]
    total = sum(w for _, _, w in cells)
    return [(c, r, w / total) for c, r, w in cells]


def smooth_grid(grid: DataFrame, columns: int, rows: int, sigma: float = 4.0) -> DataFrame:
    """(col, row, z): Gaussian means of the known cells around each cell; a cell without any in reach has no row.

    ``sigma`` counts cells; 0 or less gives the known cells as they are.  Cells meet by an exchange of sums, which a task adds up first.
    """
    known = complete(grid, ["z"]).select("col", "row", F.col("z").cast("double").alias("z"))
    if sigma <= 0:
        return known
    told = _spread(known, _offsets(gaussian_kernel(sigma)), columns, rows)
    sums = told.groupBy("col", "row").agg(F.sum(F.col("w") * F.col("z")).alias("a"), F.sum("w").alias("b"))
    return sums.select("col", "row", (F.col("a") / F.col("b")).alias("z"))


def faded(nodes: DataFrame, points: DataFrame, x: str, y: str, radius: float, background: float = 1.0) -> DataFrame:
    """``nodes`` (nx, ny, z, ...) with z faded to ``background`` between 1.5 and 3 radii from the nearest point, and null beyond.

    Nodes meet only the points of the buckets around them, which are as wide as the outer radius; equal places count once.
    """
    inner, outer = 1.5 * radius, 3.0 * radius
    bucket = lambda c: F.floor(c / outer)
    near = F.sequence(F.lit(-1), F.lit(1))
    places = complete(points, [x, y]).select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct()
    places = places.withColumns({"bx": bucket(F.col("px")), "by": bucket(F.col("py"))})
    asked = nodes.select("nx", "ny").distinct().withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    asked = asked.withColumns({"bx": bucket(F.col("nx")) + F.col("dx"), "by": bucket(F.col("ny")) + F.col("dy")})
    d2 = (F.col("nx") - F.col("px")) ** 2 + (F.col("ny") - F.col("py")) ** 2
    reach = asked.join(places, ["bx", "by"]).groupBy("nx", "ny").agg(F.min(d2).alias("__d2"))
    d = F.sqrt("__d2")
    fade = 1 - (d - inner) / (outer - inner)
    z = F.when(d <= inner, F.col("z")).when(d <= outer, F.col("z") * fade + background * (1 - fade))
    return nodes.join(reach, ["nx", "ny"], "left").withColumn("z", z).drop("__d2")


def kernel_of(n: int, var_x: float, var_y: float, covariance: float, dx: float, dy: float, cells: int, smoothing: float) -> list[tuple[int, int, float]]:
    """(dc, dr, weight): Gaussian kernel of Scott's bandwidth matrix in cells, cut at three deviations; ``smoothing`` 2 is Scott's rule itself."""
    width = n ** (-1 / 3) * smoothing / 2
    xx, xy, yy = width * var_x / (dx * dx), width * covariance / (dx * dy), width * var_y / (dy * dy)
    det = xx * yy - xy * xy
    if det < 1e-10 * (xx * yy + 1e-10):
        more = 0.1 * max(xx, yy, 1.0)
        xx, yy = xx + more, yy + more
        det = xx * yy - xy * xy
    across, up = (min(math.ceil(3 * math.sqrt(max(v, 1.0))), cells // 2) for v in (xx, yy))
    square = lambda c, r: (yy * c * c - 2 * xy * c * r + xx * r * r) / det
    told = [(c, r, math.exp(-0.5 * square(c, r))) for r in range(-up, up + 1) for c in range(-across, across + 1) if square(c, r) <= 9]
    total = sum(w for _, _, w in told)
    return [(c, r, w / total) for c, r, w in told]


def kernel_density(points: DataFrame, x: str, y: str, cells: int = 100, smoothing: float = 2.0, least: float = 0.01) -> DataFrame:
    """(col, row, density) from 0 to 1 on a grid over the padded range of the points, of the cells with ``least`` or more.

    Points are counted by nearest grid line, counts enter as log1p, and an anisotropic kernel from the points' covariance
    spreads them.  Under 10 points, or without any, no rows; points without finite coordinates are left out.
    """
    known = complete(points, [x, y]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    n, x0, x1, y0, y1, vx, vy, cov = known.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    if n < 10:
        return points.sparkSession.createDataFrame([], "col long, row long, density double")
    pads = [0.02 * ((b - a) or 1.0) for a, b in ((x0, x1), (y0, y1))]
    (x0, x1), (y0, y1) = ((a - p, b + p if b > a else a - p + 1.04 * 1.0) for (a, b), p in zip(((x0, x1), (y0, y1)), pads, strict=True))
    dx, dy = (x1 - x0) / (cells - 1), (y1 - y0) / (cells - 1)
    at = lambda c, low, step: F.floor((F.col(c) - low) / step + 0.5)
    counts = known.groupBy(at("x", x0, dx).alias("col"), at("y", y0, dy).alias("row")).agg(F.log1p(F.count("*")).alias("z"))
    counts = counts.where(F.col("col").between(0, cells - 1) & F.col("row").between(0, cells - 1))
    kernel = kernel_of(n, vx, vy, cov, dx, dy, cells, smoothing)
    spread = _spread(counts, _offsets(kernel), cells, cells).groupBy("col", "row").agg(F.sum(F.col("w") * F.col("z")).alias("d"))
    top = spread.agg(F.max("d").alias("top"))
    return spread.join(top).select("col", "row", (F.col("d") / F.col("top")).alias("density")).where(F.col("density") >= least)
