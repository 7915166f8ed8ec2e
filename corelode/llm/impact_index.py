"""Exact nearest vectors by integer inner product, from an impact-ordered index.

The rows are dealt into shards of a bounded number of rows and the queries into blocks; a task gets one shard and one
block.  A shard's index quantises each component to a level and orders, for each component, the rows by level: a
segment is the rows of one level of one component.  A query sees its components' signs: what a segment adds is never
negative once the least level (or the largest, for a negative weight) is taken as the start.  Segments are processed
by falling weight times level, in waves of falling height.  After each wave every score lies between what has been
added and that plus the same bound for all rows: the next segment of each component, and what quantising left off.
Rows whose upper bound reaches the k-th largest lower bound are the possible members.  Their exact scores are taken
when they are few, or when all segments are done; nothing stops without that proof, so no member is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelode.llm.common import written

#: Rows of a shard and queries of a block.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
#: Most tasks of a search.
MOST_PARTS = 20_000
#: Most levels of a component.
LEVELS = 64
#: So many possible members are rescored without waiting for more proof.
FEW = 64


class Shard:
    """Impact-ordered index of a matrix of whole numbers (rows by components)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.low = rows.min(axis=0)
        widest = int((rows.max(axis=0) - self.low).max(initial=0))
        self.shift = max(0, widest.bit_length() - (LEVELS.bit_length() - 1))
        level = ((rows - self.low) >> self.shift).T
        self.top = level.max(axis=1)
        self.order = np.argsort(level, axis=1, kind="stable").astype(np.int32)
        self.level = np.take_along_axis(level, self.order, axis=1)
        # Where the rows of each level start.
        self.starts = np.stack([np.searchsorted(line, np.arange(LEVELS + 2)) for line in self.level])

    def _members(self, query: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the ``k`` best; ``own`` rows take no part."""
        weight = np.abs(query).astype(np.int64) << self.shift
        used = np.flatnonzero(weight)
        slack = int(np.abs(query).sum()) * ((1 << self.shift) - 1)
        added = np.zeros(len(self.ids), np.int64)
        # Levels counted from the start of each component: those above ``done`` have been processed.
        done = self.top.copy()
        height = highest = int((weight * self.top).max(initial=0))
        allowed = np.ones(len(self.ids), bool)
        allowed[own] = False
        while True:
            # After three waves all that is left is processed.
            height = height // 2 if 8 * height > highest else 0
            for c in used:
                until = min(int(done[c]), int(height // weight[c])) if height else 0
                if until == done[c]:
                    continue
                first, last = until + 1, int(done[c])
                if query[c] > 0:
                    part = slice(self.starts[c, first], self.starts[c, last + 1])
                    added[self.order[c, part]] += weight[c] * self.level[c, part]
                else:
                    part = slice(self.starts[c, self.top[c] - last], self.starts[c, self.top[c] - first + 1])
                    added[self.order[c, part]] += weight[c] * (self.top[c] - self.level[c, part])
                done[c] = until
            bound = int((weight[used] * done[used]).sum()) + slack
            known = added[allowed]
            if len(known) <= k:
                return np.flatnonzero(allowed)
            least = np.partition(known, len(known) - k)[len(known) - k]
            possible = np.flatnonzero(allowed & (added + bound >= least))
            if len(possible) <= FEW or not done[used].any():
                return possible

    def best(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best rows of another id, ties to the smaller id."""
        found = self._members(query, np.flatnonzero(self.ids == query_id), k)
        ids, scores = self.ids[found], self.rows[found] @ query
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _whole(batches: Iterator, scale: int) -> Iterator:
    """(id, vector as little-endian 64-bit whole numbers) of the vectors that take part."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        keep = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
        ids, vectors = ids.filter(keep), vectors.filter(keep)
        value = vectors.flatten().cast(pa.float64())
        ends = np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)).astype(np.int64)
        values = value.to_numpy(zero_copy_only=False)
        bad = np.add.accumulate(np.concatenate([[0], ~np.isfinite(values)]))
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        good = bad[ends] == bad[starts]
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(scale * values)
        if (np.abs(whole[np.isfinite(values)]) >= 2**53).any():
            raise ValueError("a component is too large for exact whole numbers")
        whole = np.where(np.isfinite(whole), whole, 0).astype("<i8")
        yield pa.RecordBatch.from_arrays([
            ids.filter(pa.array(good)), pa.array([whole[a:b].tobytes() for a, b, ok in zip(starts, ends, good, strict=True) if ok], pa.binary()),
        ], names=["id", "v"])


def _matrix(column, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    vectors = [np.frombuffer(v, "<i8") for v in column.to_pylist()]
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _searched(rows, queries, k: int):
    import pyarrow as pa

    parts = [[], [], [], []]
    if rows.num_rows and queries.num_rows:
        width = max(len(v) for t in (rows, queries) for v in t.column("v").to_pylist()) // 8
        shard = Shard(rows.column("id").to_numpy(), _matrix(rows.column("v"), width))
        asked = _matrix(queries.column("v"), width)
        if width * float(np.abs(shard.rows).max(initial=0)) * float(np.abs(asked).max(initial=0)) * 4 >= 2**63:
            raise ValueError("scores may exceed a long")
        for number, query_id, query in zip(queries.column("number").to_pylist(), queries.column("id").to_pylist(), asked, strict=True):
            ids, scores = shard.best(query, query_id, k)
            for out, more in zip(parts, ([number] * len(ids), [query_id] * len(ids), ids, scores), strict=True):
                out.extend(more)
    return pa.table([pa.array(p, pa.int64()) for p in parts], names=["number", "query_id", "vec_id", "score"])


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of another id with the largest inner product.

    Vectors become floor(scale * x).  Null ids and vectors that are null or hold null or non-finite components take no
    part; shorter vectors count as ending in zeros, empty ones score 0; repeated rows are ranked one by one; a repeated
    query row is asked once; an empty table gives no rows; other columns are not read.  Components of 2^53 or scores that a long may not
    hold raise.  Rows are dealt by their place, not by their values, so equal vectors do not meet in one task.
    """
    whole = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(lambda it: _whole(it, scale), "id long, v binary")
    numbered = lambda df, tag: written(df.withColumn("number", F.monotonically_increasing_id()), tag)
    stored, asked = numbered(whole(rows), "impact-rows"), numbered(whole(queries).distinct(), "impact-queries")
    # Numbers of the parts of one file are consecutive; those of others start apart.
    shards, blocks = (max(1, -(-df.count() // most)) for df, most in ((stored, shard_rows), (asked, block_queries)))
    place = lambda n: F.pmod(F.col("number") + F.shiftright("number", 33), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stored.select("id", "v", place(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("number", "id", "v", every(shards).alias("shard"), place(blocks).alias("block"))
    # A number of its own, so that small shards are not put into one task.
    parts = min(2 * shards * blocks, MOST_PARTS)
    left, right = (df.repartition(parts, "shard", "block").groupBy("shard", "block") for df in (left, right))
    found = left.cogroup(right).applyInArrow(lambda a, b: _searched(a, b, k), "number long, query_id long, vec_id long, score long")
    turn = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
