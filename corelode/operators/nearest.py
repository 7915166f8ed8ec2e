"""Nearest neighbours by grids of growing cells, and conversion of projected coordinates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.frames import complete


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, x: str, y: str, radius: float | None = None, same: bool = False) -> DataFrame:
    """(left_id, right_id, distance): for each left row the nearest right one, within ``radius`` where given; ties go to the smaller id.

    Places are dealt into cells, and meet the places of the nine cells around.  The cells start narrow and double:
    a neighbour no farther than a cell is wide cannot be beaten, and settles its place, so that crowded places meet only in narrow cells; the others go on until the cells are as wide as
    the radius or, without one, the whole extent.  Equal places of either side meet once; of right ones the smallest id counts.  ``same`` (both sides are one table) leaves out a row's own id.  Rows without finite
    coordinates or id, and left rows without any neighbour, are left out.
    """
    told = lambda df, i, tag: complete(df.where(F.col(i).isNotNull()), [x, y]).select(F.col(i).alias(tag), F.col(x).cast("double").alias(f"{tag}x"), F.col(y).cast("double").alias(f"{tag}y"))
    out = lambda found: found.select(F.col("l").alias(left_id), F.col("r").alias(f"nearest_{right_id}"), F.sqrt("d2").alias("distance"))
    lefts, rights = told(left, left_id, "l"), told(right, right_id, "r")
    # With one table a place needs its two smallest ids: the second is the neighbour of the first.
    grouped = rights.groupBy("rx", "ry").agg(F.min("r").alias("r"), F.max("r").alias("__last"))
    if same:
        crowd = grouped.where(F.col("r") < F.col("__last")).select(F.col("rx").alias("lx"), F.col("ry").alias("ly"), F.col("r").alias("__first"))
        seconds = rights.join(crowd, (F.col("rx") == F.col("lx")) & (F.col("ry") == F.col("ly"))).where(F.col("r") > F.col("__first")).groupBy("__first").agg(F.min("r").alias("__second"))
        twins = lefts.join(crowd, ["lx", "ly"]).join(seconds, "__first").select("l", "lx", "ly", F.lit(0.0).alias("d2"), F.when(F.col("l") == F.col("__first"), F.col("__second")).otherwise(F.col("__first")).alias("r"))
        lefts = lefts.join(crowd.select("lx", "ly"), ["lx", "ly"], "left_anti").select("l", "lx", "ly")
    rights = grouped.select("rx", "ry", "r").persist()
    places = (lefts if same else lefts.groupBy("lx", "ly").agg(F.min("l").alias("l"))).select("l", "lx", "ly").persist()

    def met(some: DataFrame, width: float) -> DataFrame:
        """(l, lx, ly, d2, r): the nearest right place among the nine cells around, the smallest id of equals; a lone place's own row does not count."""
        cell = lambda c: F.floor(c / width)
        near = F.sequence(F.lit(-1), F.lit(1))
        asked = some.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
        asked = asked.select("l", "lx", "ly", (cell(F.col("lx")) + F.col("dx")).alias("cx"), (cell(F.col("ly")) + F.col("dy")).alias("cy"))
        held = rights.withColumns({"cx": cell(F.col("rx")), "cy": cell(F.col("ry"))})
        d2 = (F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2
        pairs = asked.join(held, ["cx", "cy"])
        found = (pairs.where(F.col("r") != F.col("l")) if same else pairs).groupBy("l", "lx", "ly").agg(F.min(F.struct(d2.alias("d2"), "r")).alias("m"))
        return found.select("l", "lx", "ly", "m.d2", "m.r")

    def whole(parts: list[DataFrame]) -> DataFrame:
        found = reduce(DataFrame.union, parts)
        # Each place goes back to all rows that lie there.
        return out(found.union(twins) if same else lefts.distinct().join(found.drop("l"), ["lx", "ly"]))

    box = places.select(F.col("lx").alias("x"), F.col("ly").alias("y")).union(rights.select("rx", "ry")).agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not box[0]:
        return whole([places.select("l", "lx", "ly", F.lit(0.0).alias("d2"), F.lit(None).cast(rights.schema["r"].dataType).alias("r")).limit(0)])
    wide = max(box[2] - box[1], box[4] - box[3]) or 1.0
    # Beyond the whole extent a wider radius finds no more.
    widest = wide if radius is None else max(radius, 1e-12) if radius < wide else wide
    width, parts, waiting = min(widest, wide / math.sqrt(box[0]) / 2), [], places
    while True:
        found = met(waiting, width).persist()
        last = width >= widest
        reach = radius if last else width
        settled = found if reach is None else found.where(F.col("d2") <= reach * reach)
        parts.append(settled)
        if last:
            return whole(parts)
        waiting = waiting.join(settled.select("lx", "ly"), ["lx", "ly"], "left_anti").select("l", "lx", "ly").persist()
        if waiting.isEmpty():
            return whole(parts)
        width = min(2 * width, widest)


# Equatorial radius in metres and inverse flattening of the ellipsoids.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101)}
_SCALE, _EAST, _SOUTH = 0.9996, 500_000.0, 10_000_000.0


def zone_of(epsg: int) -> tuple[str, int, bool]:
    """(ellipsoid, zone, southern) of a transverse Mercator code: 326zz and 327zz, and the southern 283zz and 78zz."""
    zone = epsg % 100
    for base, ellipsoid, south in ((32600, "WGS84", False), (32700, "WGS84", True), (28300, "GRS80", True), (7800, "GRS80", True)):
        if epsg - zone == base and 1 <= zone <= 60:
            return ellipsoid, zone, south
    raise ValueError(f"projection {epsg} is not known")


def to_wgs84(df: DataFrame, x: str, y: str, epsg: int) -> DataFrame:
    """``df`` with ``latitude`` and ``longitude`` in degrees; null without finite coordinates.

    Projected coordinates go back through the series of the transverse Mercator projection to the fourth power of the third
    flattening (well under a millimetre in a zone); 4326 is taken as longitude and latitude.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    if epsg == 4326:
        return df.withColumns({"latitude": F.when(known, b), "longitude": F.when(known, a)})
    ellipsoid, zone, south = zone_of(epsg)
    radius, flat = ELLIPSOIDS[ellipsoid]
    n = 1 / (2 * flat - 1)
    rectifying = radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # Coefficients of the inverse series and of the latitude from the conformal one.
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi = (b - (_SOUTH if south else 0.0)) / (_SCALE * rectifying)
    eta = (a - _EAST) / (_SCALE * rectifying)
    north: Column = xi
    east: Column = eta
    for k, c in enumerate(beta, 1):
        north = north - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    conformal = F.asin(F.sin(north) / F.cosh(east))
    latitude = conformal
    for k, c in enumerate(delta, 1):
        latitude = latitude + c * F.sin(2 * k * conformal)
    longitude = F.lit(float(6 * zone - 183)) + F.degrees(F.atan2(F.sinh(east), F.cos(north)))
    return df.withColumns({"latitude": F.when(known, F.degrees(latitude)), "longitude": F.when(known, longitude)})
