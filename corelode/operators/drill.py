"""Drillhole operators: desurvey, interval overlap joins, gaps and overlaps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

#: Pairs of a hole that a task works out at once.
PAIRS_AT_ONCE = 1_000_000


def trajectory(collar: DataFrame, survey: DataFrame) -> DataFrame:
    """Stations with x, y, z, by average angles; a station at depth 0 is added where missing.

    collar: hole, x, y, z; survey: hole, depth, azimuth, dip (degrees).  Holes with more than one collar are left out,
    as nothing tells which is right.
    """
    once = F.count("*").over(Window.partitionBy("hole")) == 1
    collar = collar.withColumn("__once", once).where("__once").drop("__once")
    first = survey.groupBy("hole").agg(F.min(F.struct("depth", "azimuth", "dip")).alias("f")).where("f.depth > 0")
    stations = survey.select("hole", "depth", "azimuth", "dip").union(
        first.select("hole", F.lit(0.0).alias("depth"), "f.azimuth", "f.dip")
    )
    w = Window.partitionBy("hole").orderBy("depth", "azimuth", "dip")
    step = F.coalesce(F.col("depth") - F.lag("depth").over(w), F.lit(0.0))
    mean = lambda c: F.radians((F.col(c) + F.lag(c).over(w)) / 2)
    moved = stations.select(
        "hole", "depth", "azimuth", "dip",
        F.coalesce(step * F.cos(mean("dip")) * F.sin(mean("azimuth")), F.lit(0.0)).alias("dx"),
        F.coalesce(step * F.cos(mean("dip")) * F.cos(mean("azimuth")), F.lit(0.0)).alias("dy"),
        F.coalesce(step * F.sin(mean("dip")), F.lit(0.0)).alias("dz"),
    )
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = moved.join(collar, "hole").select(
        "hole", "depth", "azimuth", "dip",
        *[(F.coalesce(c, F.lit(0.0)) + F.sum(f"d{c}").over(run)).alias(c) for c in ("x", "y", "z")],
    )
    return placed


def desurvey(collar: DataFrame, survey: DataFrame, intervals: DataFrame) -> DataFrame:
    """``intervals`` (hole, from, to, ...) with x, y, z at their middles, linear between stations, clamped at both ends.

    Stations and middles run through one window by hole and depth, so the work is linear in a hole's rows.
    Intervals of holes without a single collar or without stations are left out.
    """
    path = trajectory(collar, survey).select("hole", F.col("depth").alias("__at"), F.struct("depth", "x", "y", "z").alias("__s"))
    rows = intervals.select("hole", ((F.col("from") + F.col("to")) / 2).alias("__at"), F.struct(*intervals.columns).alias("__i"))
    both = path.select("*", F.lit(None).cast(rows.schema["__i"].dataType).alias("__i")).unionByName(
        rows.withColumn("__s", F.lit(None).cast(path.schema["__s"].dataType))
    )
    # A station comes before the middles at its depth.
    w = Window.partitionBy("hole").orderBy("__at", F.col("__s").isNull())
    above = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("__s", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = both.select("*", above.alias("__a"), below.alias("__b")).where("__i is not null and coalesce(__a, __b) is not null")
    a, b = (lambda c: F.coalesce(f"__a.{c}", f"__b.{c}")), (lambda c: F.coalesce(f"__b.{c}", f"__a.{c}"))
    share = F.coalesce(F.try_divide(F.col("__at") - a("depth"), b("depth") - a("depth")), F.lit(0.0))
    return found.select("__i.*", *[(a(c) + share * (b(c) - a(c))).alias(c) for c in ("x", "y", "z")])


def overlapping_logs(intervals: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(hole, overlaps, categories): pairs of a hole's intervals that overlap, and the categories that take part; holes without any are left out.

    intervals: hole, from, to, category.  Pairs are counted from the intervals begun and ended before each start, without forming them.
    """
    rows = intervals.where(F.col("to") > F.col("from"))
    starts = rows.select("hole", F.col("from").alias("at"), F.lit(1).alias("start"), F.lit(0).alias("end"), F.struct("from", "to", "category").alias("i"))
    ends = rows.select("hole", F.col("to").alias("at"), F.lit(0), F.lit(1), F.lit(None).cast(starts.schema["i"].dataType))
    w = Window.partitionBy("hole").orderBy("at", "start", "i.to")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.sum("start").over(upto) - F.sum("end").over(upto) - 1
    both = starts.union(ends).select("hole", "i", open_.alias("open"), F.max("i.to").over(past).alias("reach"), F.min("i.from").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    told = both.where("i is not null").withColumn("hit", F.coalesce(F.col("reach") > F.col("i.from"), F.lit(False)) | F.coalesce(F.col("next") < F.col("i.to"), F.lit(False)))
    found = told.groupBy("hole").agg(F.sum("open").alias("overlaps"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("i.category")))), "|").alias("categories"))
    return found.where("overlaps > 0")


def _by_depth(rows: DataFrame, spans: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` once for each depth bucket of their hole that they reach, from that of their start to that of their end."""
    at = lambda depth: F.floor((F.least(F.col(depth).cast("double"), F.col("__high")) - F.col("__low")) / F.col("__width"))
    # What starts at minus infinity reaches every bucket from the first.
    placed = rows.join(spans, "hole").withColumn("__start", F.when(F.col(start).cast("double") == float("-inf"), F.col("__low")).otherwise(F.col(start).cast("double")))
    placed = placed.where(F.col("__start").between(F.col("__low"), F.col("__high")))
    start = "__start"
    last = F.when(F.col(end) > F.col(start), at(end)).otherwise(at(start))
    return placed.withColumn("__bucket", F.explode(F.sequence(at(start), last))).drop("__start")


def _met_by_depth(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides that share a depth bucket: the one in which the later of their starts lies, so each pair comes once.

    A hole has a bucket for each of its rows, of equal width, so intervals that cover a hole a few times over fall
    into a few buckets each, however many there are.
    """
    depths = left.select("hole", "from", "to").unionByName(right.select("hole", F.col("r_from").alias("from"), F.col("r_to").alias("to")))
    told = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    starts, ends = F.when(told("from"), F.col("from").cast("double")), F.when(told("to"), F.col("to").cast("double"))
    # Least, greatest and count do not hang on the order of rows, so both sides get the very same buckets.
    low, high = F.min(starts), F.greatest(F.max(starts), F.max(ends))
    spans = depths.groupBy("hole").agg(low.alias("__low"), high.alias("__high"), F.count("*").alias("__n"))
    wide = (F.col("__high") - F.col("__low")) / F.col("__n")
    spans = spans.select("hole", "__low", "__high", F.when(wide > 0, wide).otherwise(1.0).alias("__width"))
    a, b = _by_depth(left, spans, "from", "to"), _by_depth(right, spans, "r_from", "r_to")
    met = a.join(b.drop("__low", "__high", "__width"), ["hole", "__bucket"])
    later = F.greatest(F.col("from").cast("double"), F.col("r_from").cast("double"), F.col("__low"))
    return met.where(F.floor((later - F.col("__low")) / F.col("__width")) == F.col("__bucket")).drop("__bucket", "__low", "__high", "__width")


def overlaps(left: DataFrame, right: DataFrame, least_pct: float = 0.0, deep: bool = False) -> DataFrame:
    """Pairs of a hole whose overlap is over ``least_pct`` of the left interval's length.

    left: hole, row_id, from, to; right: hole, log_id, from, to, category.  Holes meet by key, which forms all pairs of
    a hole; with ``deep``, for holes of over some 5,000 rows, rows meet by depth buckets and the work follows the pairs
    that overlap.  Then intervals whose start is NaN, null or plus infinity take no part.
    """
    r = right.select("hole", "log_id", F.col("from").alias("r_from"), F.col("to").alias("r_to"), "category")
    length = F.when(F.col("to") > F.col("from"), F.col("to") - F.col("from")).otherwise(1e-10)
    pct = F.greatest(F.lit(0.0), F.least("to", "r_to") - F.greatest("from", "r_from")) / length * 100
    rows = left.select("hole", "row_id", "from", "to")
    met = _met_by_depth(rows, r) if deep else rows.join(r, "hole")
    pairs = met.where((F.col("r_from") < F.col("to")) & (F.col("from") < F.col("r_to")))
    return pairs.withColumn("pct", pct).where(F.col("pct") > least_pct)


def max_overlap(left: DataFrame, right: DataFrame, deep: bool = False) -> DataFrame:
    """Each left row with the category of its largest overlap; ties go to the smaller log_id; unmatched rows stay."""
    best = overlaps(left, right, deep=deep).groupBy("hole", "row_id").agg(F.max(F.struct("pct", (-F.col("log_id")).alias("o"), "category")).alias("b"))
    best = best.select("hole", "row_id", F.col("b.category").alias("category"), F.col("b.pct").alias("pct"))
    return left.join(best, ["hole", "row_id"], "left").select(*left.columns, "category", F.coalesce("pct", F.lit(0.0)).alias("pct"))


def _hole_matcher():
    """The task of ``matched``: whole holes of both sides, some at a time.  Its parts lie inside, so workers need nothing of this package."""
    most = PAIRS_AT_ONCE

    def spread(first: np.ndarray, past: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place) for all places from ``first`` to before ``past`` of each row, about ``most`` at a time."""
        held = np.maximum(past - first, 0)
        upto, row = np.cumsum(held), 0
        while row < len(held):
            before = upto[row] - held[row]
            end = max(row + 1, int(np.searchsorted(upto, before + most, "right")))
            rows = np.repeat(np.arange(row, end), held[row:end])
            yield rows, (first - upto + held)[rows] + before + np.arange(len(rows))
            row = end

    def ranks(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(place of each value among the distinct ones in rising order, -1 for null; those values)."""
        coded = column.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.full(len(order) + 1, -1)
        place[order.to_numpy()] = np.arange(len(order))
        return place[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)], coded.dictionary.take(order)

    def greatest(rows: list[np.ndarray]) -> list[np.ndarray]:
        """The greatest (percentage, order, category) of each id, from (id, percentage, order, category); NaN is the greatest percentage."""
        order = np.lexsort(rows[::-1])
        ids = rows[0][order]
        last = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) if len(ids) else ids
        return [c[order[last]] for c in rows]

    def told(rows: pa.RecordBatch, hole: np.ndarray) -> pa.RecordBatch:
        """Left rows with category, percentage and codes, of whole holes.

        Starts are searched in the sorted starts of the other side, so only pairs that overlap are formed, whatever the depths:
        logs that start from the left row's start on and before its end, and left rows that start inside a log.
        """
        logged = rows["rows"].to_numpy() < 0
        left, log = rows.filter(pa.array(~logged)), rows.filter(pa.array(logged))
        start, end = (rows[c].fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        known = lambda c: rows[c].is_valid().to_numpy(zero_copy_only=False)
        takes = known("hole") & known("end") & (logged | known("row_id")) & (start < np.inf)
        # An end that is no number lies beyond all others.
        reach = np.where(np.isnan(end), np.inf, end)
        depths = np.unique(np.concatenate([start[takes], reach[takes]]))
        # Starts and ends as whole numbers that rise by hole, then depth.
        from_, to = (hole * (len(depths) + 1) + np.searchsorted(depths, v) for v in (start, reach))
        a, b = (np.flatnonzero(takes & side) for side in (~logged, logged))
        a, b = a[np.argsort(from_[a], kind="stable")], b[np.argsort(from_[b], kind="stable")]
        # Rows of one hole and row_id are told the same.
        _, ids = np.unique(hole[~logged] * (len(left) + 1) + ranks(left["row_id"])[0], return_inverse=True)
        id_ = ids[(np.cumsum(~logged) - 1)[a]]
        kind, categories = ranks(log["category"])
        number, numbers = ranks(log["log_id"])
        # Of equal percentages the smaller log_id comes first, one that is null last.
        order = np.where(number < 0, -len(numbers) - 1, -number)
        of = (np.cumsum(logged) - 1)[b]
        kind, order = kind[of], order[of]
        later = spread(np.searchsorted(from_[b], from_[a]), np.searchsorted(from_[b], to[a]))
        inside = ((i, j) for j, i in spread(np.searchsorted(from_[a], from_[b], "right"), np.searchsorted(from_[a], to[b])))
        start_a, end_a, reach_a, start_b, end_b, reach_b = start[a], end[a], reach[a], start[b], end[b], reach[b]
        best, seen = [np.arange(0), np.zeros(0), np.arange(0), np.arange(0)], np.arange(0)
        for i, j in chain(later, inside):
            with np.errstate(invalid="ignore", over="ignore"):
                shared = np.maximum(0.0, np.fmin(end_a[i], end_b[j]) - np.maximum(start_a[i], start_b[j]))
                pct = shared / np.where(reach_a[i] > start_a[i], end_a[i] - start_a[i], 1e-10) * 100
            met = (start_b[j] < reach_a[i]) & (start_a[i] < reach_b[j]) & ~(pct <= 0)
            i, j, pct = i[met], j[met], pct[met]
            best = greatest([np.concatenate(c) for c in zip(best, (id_[i], pct, order[j], kind[j]), strict=True)])
            seen = np.unique(np.concatenate([seen, id_[i] * (len(categories) + 1) + kind[j] + 1]))
        found, pct, _, kind = best
        seen_id, seen_kind = np.divmod(seen, len(categories) + 1)
        seen_id, seen_kind = seen_id[seen_kind > 0], seen_kind[seen_kind > 0] - 1
        bounds = np.append(np.searchsorted(seen_id, found), len(seen_id)).astype(np.int32)
        codes = pc.binary_join(pa.ListArray.from_arrays(bounds, categories.cast(pa.string()).take(pa.array(seen_kind))), " | ")
        place = np.full(len(left) + 1, -1)
        place[found] = np.arange(len(found))
        place = pa.array(place[ids], mask=place[ids] < 0)
        best = {"category": categories.take(pa.array(kind, mask=kind < 0)), "pct": pa.array(pct), "codes": codes}
        own = [c for c in rows.schema.names if c not in ("rows", "log_id", "category")]
        return pa.RecordBatch.from_arrays([left[c] for c in own] + [v.take(place) for v in best.values()], names=[*own, *best])

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is told of the holes that have come whole; the rows of one that has not wait for the next batch."""
        held, n, wanted = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < wanted or not n:
                continue
            rows = pa.concat_batches(held)
            sizes, at, whole = np.abs(rows["rows"].to_numpy()), 0, []
            while at < n and at + sizes[at] <= n:
                whole.append(sizes[at])
                at += sizes[at]
            if whole:
                if (sizes[:at] != np.repeat(whole, whole)).any():
                    raise ValueError("the rows of a hole do not lie beside each other")
                yield told(rows.slice(0, at), np.repeat(np.arange(len(whole)), whole))
            held, n, wanted = [rows.slice(at)], n - at, sizes[at] if at < n else 0
        if n:
            raise ValueError("the rows of a hole are not in one task")

    return holes


def matched(left: DataFrame, right: DataFrame, deep: bool = False) -> DataFrame:
    """Each left row with what ``max_overlap`` and ``combine_codes`` tell, from one meeting of both sides.

    With ``deep`` a task takes whole holes of both sides and the work follows the pairs that overlap.  Rows are dealt by
    hole only: sides that already are, as after a window by hole, are not dealt again.  Then intervals whose start is NaN,
    null or plus infinity take no part.
    """
    if deep:
        own = [c for c in left.columns if c not in ("hole", "row_id", "from", "to") or c in ("from", "to") and left.schema[c].dataType != DoubleType()]
        depths = [F.col("from").cast("double").alias("start"), F.col("to").cast("double").alias("end")]
        rows = left.select("hole", F.lit(1).alias("rows"), "row_id", *depths, *[F.col(c).alias(f"left_{c}") for c in own])
        logs = right.select("hole", F.lit(-1).alias("rows"), *depths, "log_id", "category")
        # The window puts the rows of a hole beside each other in one task and tells how many they are, below 0 on logs.
        size = F.count("*").over(Window.partitionBy("hole"))
        sides = rows.unionByName(logs, allowMissingColumns=True).withColumn("rows", F.col("rows") * size)
        kind = sides.schema["category"].dataType
        shape = StructType([f for f in sides.schema if f.name not in ("rows", "log_id", "category")]).add("category", kind).add("pct", DoubleType()).add("codes", StringType())
        found = sides.mapInArrow(_hole_matcher(), shape)
        at = {"hole": "hole", "row_id": "row_id", "from": "start", "to": "end"} | {c: f"left_{c}" for c in own}
        return found.select(*[F.col(at[c]).cast(left.schema[c].dataType).alias(c) for c in left.columns], "category", F.coalesce("pct", F.lit(0.0)).alias("pct"), "codes")
    best = F.max(F.struct("pct", (-F.col("log_id")).alias("o"), "category")).alias("b")
    codes = F.array_join(F.array_sort(F.collect_set("category")), " | ").alias("codes")
    told = overlaps(left, right).groupBy("hole", "row_id").agg(best, codes)
    told = told.select("hole", "row_id", F.col("b.category").alias("category"), F.col("b.pct").alias("pct"), "codes")
    return left.join(told, ["hole", "row_id"], "left").select(*left.columns, "category", F.coalesce("pct", F.lit(0.0)).alias("pct"), "codes")


def combine_codes(left: DataFrame, right: DataFrame, deep: bool = False) -> DataFrame:
    """Each left row with its distinct overlapping categories, sorted and joined; unmatched rows stay."""
    codes = overlaps(left, right, deep=deep).groupBy("hole", "row_id").agg(F.array_join(F.array_sort(F.collect_set("category")), " | ").alias("codes"))
    return left.join(codes, ["hole", "row_id"], "left")


def split_columns(left: DataFrame, right: DataFrame, base: str, values: list[str], deep: bool = False) -> DataFrame:
    """Each left row with a Yes/No column for each category."""
    flags = [F.max(F.when(F.col("category") == v, "Yes")).alias(f"{base}_{v.replace(' ', '')}") for v in values]
    found = overlaps(left, right, deep=deep).groupBy("hole", "row_id").agg(*flags)
    names = [f"{base}_{v.replace(' ', '')}" for v in values]
    return left.join(found, ["hole", "row_id"], "left").select(*left.columns, *[F.coalesce(n, F.lit("No")).alias(n) for n in names])


def gaps_and_overlaps(intervals: DataFrame, order: list[str], tolerance: float = 0.001) -> DataFrame:
    """Counts of gaps and overlaps between consecutive intervals of each hole.

    Equal intervals of a hole are one row with their number, as all steps between them are equal; which of them comes first (``order``) changes no count.
    """
    w = Window.partitionBy("hole").orderBy("from", "to")
    rows = intervals.groupBy("hole", "from", "to").agg((F.count("*") - 1).alias("more"))
    step = rows.withColumns({"step": F.lead("from").over(w) - F.col("to"), "own": F.col("from") - F.col("to")})
    told = lambda c: F.when(c("step"), 1).otherwise(0) + F.when(c("own"), F.col("more")).otherwise(0)
    gap, crossed = told(lambda c: F.col(c) > tolerance), told(lambda c: F.col(c) < -tolerance)
    return step.groupBy("hole").agg(F.sum(gap).alias("gaps"), F.sum(crossed).alias("overlaps"))


def holes_missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Holes of ``left`` that ``right`` lacks."""
    return left.select("hole").distinct().join(right.select("hole").distinct(), "hole", "left_anti")
