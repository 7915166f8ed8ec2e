"""Best-fit packing by patterns: few-document length patterns fitted to the histogram of lengths.

Only the histogram (at most ``capacity`` counts, whatever the corpus) goes to the driver.  There,
patterns of one to three lengths that fill a sequence exactly are enumerated; their repeat counts
are fitted to the histogram by non-negative least squares and rounded down; what remains is packed
best-fit-decreasing, again on counts.  The plan, bounded by the capacity and the pattern rule, tells
each length which ranks go where; Spark ranks the pieces and looks them up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelode.llm.common import written

CAPACITY = 4096
#: Middle lengths tried for each longest length of a three-document pattern.
MIDDLES = 48
NNLS_STEPS = 300
#: Pieces of one length are ranked in so many parts, so a common length needs no task of its own.
RANK_PARTS = 64


def _pieces(batches: Iterator, path: str, end_id: int, capacity: int) -> Iterator:
    import pyarrow as pa

    from corelode.llm.bpe import encoder
    from corelode.llm.common import byte_texts

    tail = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            rows: list[tuple] = []
            which: list[int] = []
            for i, ids in enumerate(encoder(path).encode(byte_texts(part.column(1)))):
                ids += tail
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[a : a + 4 * capacity]
                    rows.append((k, a // 4, len(cut) // 4, zlib.crc32(cut)))
                    which.append(i)
            k, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(which, pa.int32())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY
) -> DataFrame:
    """Per input row the pieces of its ids and the end id: id, piece, start, length, ids_crc32.  No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(
        lambda it: _pieces(it, tokenizer_path, end_id, capacity),
        f"id {kind}, piece int, start long, length long, ids_crc32 long",
    )


def patterns(lengths: np.ndarray, capacity: int = CAPACITY, middles: int = MIDDLES) -> np.ndarray:
    """Rows of three lengths, longest first and 0 for none, that fill ``capacity`` and occur in ``lengths``."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    held = np.flatnonzero(there[1:]) + 1
    rows = [(capacity, 0, 0)] if there[capacity] else []
    rows += [(a, capacity - a, 0) for a in held[held * 2 >= capacity].tolist() if a < capacity and there[capacity - a]]
    for a in held[(held * 3 >= capacity) & (held <= capacity - 2)].tolist():
        rest = capacity - a
        b = held[(held <= min(a, rest - 1)) & (held * 2 >= rest)]
        b = b[there[rest - b]]
        rows += [(a, int(x), rest - int(x)) for x in b[np.unique(np.linspace(0, len(b) - 1, min(len(b), middles)).astype(int))]]
    return np.array(rows, np.int64).reshape(-1, 3)


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative repeat counts x that bring the lengths used by ``rows`` near ``histogram`` (least squares)."""
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        total = np.bincount(rows.ravel(), np.repeat(x, 3), size)
        total[0] = 0
        return total

    goal = histogram.astype(float)
    goal[0] = 0
    toward = goal[rows].sum(axis=1)
    x = np.maximum(goal[rows].max(axis=1) / 8, 1e-3)
    for _ in range(steps):  # multiplicative steps: they keep x non-negative and never raise the error
        x = x * toward / np.maximum(used(x)[rows].sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, repeats, first sequence, offset) of each slot; every counted piece has one place."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    slots: list[tuple[int, int, int, int, int]] = []
    taken = np.zeros(capacity + 1, np.int64)
    sequences = 0

    def put(lengths: list[int], repeats: int) -> None:
        nonlocal sequences
        offset = 0
        for n in lengths:
            slots.append((n, int(taken[n]), repeats, sequences, offset))
            taken[n] += repeats
            left[n] -= repeats
            offset += n
        sequences += repeats

    rows = patterns(np.flatnonzero(left), capacity)
    if len(rows):
        fitted = fit(rows, left)
        for k in np.argsort(-fitted, kind="stable").tolist():
            if (most := int(round(fitted[k]))) < 1:
                break
            lengths = [n for n in rows[k].tolist() if n]
            most = min(most, *(int(left[n]) // lengths.count(n) for n in lengths))
            if most > 0:
                put(lengths, most)
    # Residuals, best-fit-decreasing on counts: groups of equal sequences by the room they have left.
    room: dict[int, list[tuple[list[int], int]]] = {}
    open_rooms = np.zeros(capacity + 1, np.int64)
    done: list[tuple[list[int], int]] = []

    def shelve(lengths: list[int], count: int, free: int) -> None:
        if free:
            room.setdefault(free, []).append((lengths, count))
            open_rooms[free] += count
        else:
            done.append((lengths, count))

    for n in np.flatnonzero(left)[::-1].tolist():
        count = int(left[n])
        while count:
            fits = np.flatnonzero(open_rooms[n:])
            if not len(fits):
                each = capacity // n
                if count >= each:
                    shelve([n] * each, count // each, capacity - n * each)
                    count %= each
                if count:
                    shelve([n] * count, 1, capacity - n * count)
                break
            free = int(fits[0]) + n
            lengths, there = room[free].pop()
            open_rooms[free] -= there
            now = min(count, there)
            if there > now:
                shelve(lengths, there - now, free)
            shelve([*lengths, n], now, free - n)
            count -= now
    for lengths, count in [*done, *(x for group in room.values() for x in group)]:
        put(lengths, count)
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset; each has a ``length`` of 1 to ``capacity``.

    Equal keys (repeated rows) are separate pieces.  ``pieces`` must be a written table: it is read twice.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, count in counted:
        histogram[length] = count
    part = F.pmod(F.xxhash64(*key), F.lit(RANK_PARTS))
    sizes = pieces.groupBy("length", part.alias("part")).count()  # at most capacity * RANK_PARTS rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    turn = Window.partitionBy("length", "part").orderBy(*key)
    ranked = pieces.withColumn("part", part).withColumn("turn", F.row_number().over(turn))
    ranked = ranked.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("turn") - 1)
    slots = plan(histogram, capacity)
    by: dict[int, list[tuple]] = {}
    for length, *slot in slots:
        by.setdefault(length, []).append(tuple(slot))
    schema = "length long, slots array<struct<first:long,repeats:long,sequence:long,offset:long>>"
    placed = ranked.join(F.broadcast(spark.createDataFrame(list(by.items()), schema)), "length")  # one row per length
    slot = F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["repeats"]))[0]
    placed = placed.withColumn("slot", slot)
    return placed.select(
        *pieces.columns,
        (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: its piece is the end id alone.  Repeated rows are packed each;
    an empty table gives no rows; other columns are not read.
    """
    pieces = written(token_pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity), "pieces")
    packed = pack(pieces, capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
