"""SimHash fingerprints and near-duplicate groups by BK-trees over fingerprint shards.

Distinct fingerprints are dealt to shards by a shared block of bits: with radius r and r + 1
blocks, two fingerprints at most r bits apart agree on one block at least, so each link lies in
some shard.  A shard whose block value is common is dealt again by blocks of its other bits, so
no shard holds a large share of the rows.  Each shard gets a BK-tree, whose children are keyed by
their Hamming distance to the parent; searches follow only edges within the radius of the
distance to the node.  Shards are built and searched inside the tasks that hold them, all trees
of a task at once level by level: sending all trees to all tasks has no size bound.

``keep_one`` keeps one document of each of these groups where they are given.  Without them it asks for a Jaccard similarity, which SimHash
bits tell more coarsely: candidates share one of many min-hash fingerprints, and each link is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelode.llm.common import written
from corelode.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
#: A shard of more distinct fingerprints than this is dealt again.
SHARD_ROWS = 4096
#: Least similarity of near-duplicate documents in ``keep_one``, as a fraction; fingerprints of a set and minima in each.
SIMILARITY = (4, 5)
BANDS = 25
BAND_ROWS = 5
_MIN_FACTORS, _MIN_SHIFTS = np.random.default_rng(25).integers(1 << 63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE_FACTORS = np.random.default_rng(26).integers(1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(raw: bytes, width: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the hashed word shingles of an UTF-8 text, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[s : s + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator, width: int) -> Iterator:
    import pyarrow as pa

    from corelode.llm.common import byte_texts

    for batch in batches:
        found = np.array([fingerprint(t, width) for t in byte_texts(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long) per input row; a null or wordless text has fingerprint 0.  No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(lambda it: _fingerprints(it, width), f"id {kind}, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class BkForest:
    """One BK-tree per shard.  Nodes are the given fingerprints; children are kept by (parent, distance)."""

    def __init__(self, fps: np.ndarray, shards: np.ndarray):
        """``shards``: a small integer per fingerprint; equal fingerprints of a shard must not repeat."""
        n = len(fps)
        self.fps, self.parent, self.edge = fps, np.full(n, -1), np.zeros(n, np.int16)
        order = np.argsort(shards, kind="stable")
        first = np.r_[True, shards[order][1:] != shards[order][:-1]] if n else np.zeros(0, bool)
        roots = order[first]
        self.root_of = np.zeros(n, np.int64)
        self.root_of[order] = roots[np.cumsum(first) - 1] if n else 0
        waiting, under = np.setdiff1d(np.arange(n), roots, assume_unique=True), None
        under = self.root_of[waiting]
        while len(waiting):
            d = _distance(fps[waiting], fps[under])
            key = under * 65 + d
            order = np.argsort(key, kind="stable")
            waiting, under, d, key = waiting[order], under[order], d[order], key[order]
            lead = np.r_[True, key[1:] != key[:-1]]
            self.parent[waiting[lead]], self.edge[waiting[lead]] = under[lead], d[lead]
            under = waiting[lead][np.cumsum(lead) - 1]
            waiting, under = waiting[~lead], under[~lead]
        held = np.flatnonzero(self.parent >= 0)
        by = held[np.argsort(self.parent[held] * 65 + self.edge[held], kind="stable")]
        self.children, self.child_keys = by, self.parent[by] * 65 + self.edge[by]

    def within(self, radius: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b), a after b, at most ``radius`` bits apart in one shard, for blocks of query nodes."""
        for s in range(0, len(self.fps), block):
            query = np.arange(s, min(len(self.fps), s + block))
            node = self.root_of[query]
            while len(query):
                d = _distance(self.fps[query], self.fps[node])
                hit = (d <= radius) & (query > node)
                if hit.any():
                    yield query[hit], node[hit]
                lo = np.searchsorted(self.child_keys, node * 65 + np.maximum(d - radius, 0), "left")
                hi = np.searchsorted(self.child_keys, node * 65 + np.minimum(d + radius, 64), "right")
                many = hi - lo
                query = np.repeat(query, many)
                node = self.children[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(query))] if len(query) else query


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b in ``label``, in place; each label is a node with a label no larger."""
    while len(a):
        ra, rb = label[a], label[b]
        while (m := label[ra] != ra).any():
            ra = np.where(m, label[ra], ra)
        while (m := label[rb] != rb).any():
            rb = np.where(m, label[rb], rb)
        apart = ra != rb
        a, b = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
        np.minimum.at(label, a, b)


def _shard_links(batches: Iterator, radius: int) -> Iterator:
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
    if not parts:
        return
    shard, fp, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(rep, kind="stable")
    shard, fp, rep = shard[order], fp[order].view(np.uint64), rep[order]
    dense = np.unique(shard, return_inverse=True)[1]
    label = np.arange(len(fp))
    for a, b in BkForest(fp, dense).within(radius):
        _merge(label, a, b)
    while (label[label] != label).any():
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], names=["src", "dst"])


def _block(column, start: int, bits: int):
    return F.shiftrightunsigned(column, start).bitwiseAND(F.lit((1 << bits) - 1))


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(start, bits) of ``parts`` blocks of nearly equal size."""
    cuts = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def near_links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(src, dst) links that connect all fingerprints at most ``radius`` apart; ``distinct``: (fp, rep), each fp once.

    Links join the right groups but are not all pairs: inside a shard each node is linked to the
    first of its group.  Searches cover every pair, whatever the size of a shard.
    """
    blocks = _blocks(64, radius + 1)
    fp = F.col("fp")
    keyed = F.array(*[F.struct(F.lit(k).alias("k"), _block(fp, a, n).alias("value")) for k, (a, n) in enumerate(blocks)])
    dealt = distinct.select("fp", "rep", F.explode(keyed).alias("s")).select("fp", "rep", "s.k", "s.value")
    sizes = dealt.groupBy("k", "value").count()
    hot = written(sizes.where(F.col("count") > shard_rows).select("k", "value", F.lit(1).alias("hot")), "hot-shards")
    dealt = dealt.join(hot, ["k", "value"], "left")
    # The other bits of a hot shard's members, again in radius + 1 blocks.
    rest = None
    for k, (a, n) in enumerate(blocks):
        low = fp.bitwiseAND(F.lit((1 << a) - 1)) if a else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, a + n), a) if a + n < 64 else F.lit(0).cast("long")
        rest = (F.when if rest is None else rest.when)(F.col("k") == k, low.bitwiseOR(high))
    fine = F.array(*[
        F.struct(F.lit(j).alias("j"), _block(rest, a, n).alias("more"))
        for j, (a, n) in enumerate(_blocks(64 - 64 // (radius + 1), radius + 1))
    ])
    none = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("more")))
    rows = dealt.select("fp", "rep", "k", "value", F.explode(F.when(F.col("hot") == 1, fine).otherwise(none)).alias("f"))
    rows = rows.select(F.xxhash64("k", "value", "f.j", "f.more").alias("shard"), "fp", "rep")
    found = rows.repartition("shard").mapInArrow(lambda it: _shard_links(it, radius), "src long, dst long")
    return found.distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """(id, fingerprint, component_id) per input row; component_id is the smallest id reachable by links.

    Ids are integers.  Equal texts share a fingerprint and so a group; null and empty texts have
    fingerprint zero and are linked like any other.  A row with a null id keeps its fingerprint and
    has the group of its fingerprint (null where only such rows have it).  Other columns are not read.
    """
    prints = written(
        fingerprints(docs, id_col, text_col, width).select(F.col("id").cast("long").alias("id"), "fp"), "fingerprints"
    )
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    groups = connected_components(near_links(distinct.where("rep is not null"), radius))
    named = distinct.join(groups, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BYTE_VALUES = np.random.default_rng(8).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of ``h``; one to one."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return h ^ h >> np.uint64(32)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, line) of every word of the lines of ``texts``, lines counted through, and their number."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = ~_SPACE[raw]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    breaks = np.flatnonzero(raw == 10)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), len(breaks)
    lengths = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1 - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(lengths.max(), _BASE))
    hashes = np.add.reduceat(_BYTE_VALUES[raw[inside]] * powers[place], first)
    return _mixed(hashes), np.searchsorted(breaks, starts), len(breaks)


def shingle_set(raw: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a lower-cased text; of all its words if they are fewer."""
    words = _word_hashes([raw])[0]
    width = max(1, min(width, len(words)))
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(words) else 0):
        total += words[k : k + len(total)] * _SHINGLE_FACTORS[k]
    return np.unique(_mixed(total + np.uint64(width)))


def min_hash_bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS independent fingerprints of a set, each of BAND_ROWS minima over its hashed members."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 1024):
        low = np.minimum(low, (_MIN_FACTORS[:, None] * shingles[None, s : s + 1024] + _MIN_SHIFTS[:, None]).min(axis=1))
    rows = _mixed(low.reshape(BANDS, BAND_ROWS)) * _SHINGLE_FACTORS[:BAND_ROWS]
    return _mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _set_rows(batches: Iterator, width: int) -> Iterator:
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    from corelode.llm.common import byte_texts

    for batch in batches:
        sets = [shingle_set(t, width) for t in byte_texts(batch.column(1))]
        bands = [min_hash_bands(v).view(np.int64) if len(v) else [] for v in sets]
        columns = [batch.column(0), pa.array([xxh3_128_digest(v.tobytes()) for v in sets], pa.binary()), pa.array([len(v) for v in sets], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], names=["id", "same", "n", "bands"])


def _shingle_rows(batches: Iterator, width: int) -> Iterator:
    import pyarrow as pa

    from corelode.llm.common import byte_texts

    for batch in batches:
        sets = [shingle_set(t, width).tobytes() for t in byte_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _similar(batches: Iterator, similarity) -> Iterator:
    import pyarrow as pa

    num, den = similarity
    for batch in batches:
        true = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            true.append(common * den >= (len(a) + len(b) - common) * num)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(true, pa.bool_())], names=["src", "dst", "similar"])


def _verified(texts: DataFrame, pairs: DataFrame, width: int, similarity) -> DataFrame:
    """Written (src, dst) of the pairs whose shingle sets really are similar; ``texts``: (id, t)."""
    wanted = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    sets = texts.join(wanted, "id", "left_semi").mapInArrow(lambda it: _shingle_rows(it, width), "id long, shingles binary")
    sets = written(sets, "shingle-sets")
    both = pairs.join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("a")), "src")
    both = both.join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b")), "dst").select("src", "dst", "a", "b")
    found = both.mapInArrow(lambda it: _similar(it, similarity), "src long, dst long, similar boolean")
    return written(found.where("similar").select("src", "dst"), "similar-pairs")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity=SIMILARITY) -> DataFrame:
    """(id, component_id) of each id with the group of its text: texts of equal shingle sets, or linked by pairs of that similarity.

    Texts that share one of BANDS fingerprints are candidates, each pair verified on its whole
    shingle sets.  Sets are first held against the smallest id of each of their fingerprints; then, where a
    fingerprint still joins several groups, its members outside the group of its smallest id are held against all
    its members of other groups, so that a large group of near copies is not joined with itself.
    """
    num, den = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("t")).where("id is not null")
    rows = written(texts.mapInArrow(lambda it: _set_rows(it, width), "id long, same binary, n int, bands array<long>"), "shingle-bands")
    reps = rows.groupBy("same").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    posted = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = posted.groupBy("key").agg(F.min("rep").alias("lead"), F.min_by("n", "rep").alias("lead_n"), F.count("*").alias("many")).where("many > 1")
    posted = written(posted.join(shared.drop("many"), "key"), "shared-bands")
    sized = lambda m, n: F.least(m, n) * den >= F.greatest(m, n) * num
    led = posted.where("rep <> lead").where(sized(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("src"), F.col("rep").alias("dst"))
    led = written(led.distinct(), "lead-pairs")
    first = _verified(texts, led, width, similarity)
    groups = connected_components(first)
    at = posted.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = at.groupBy("key").agg(F.min_by("component", "rep").alias("main"), F.min("component").alias("c"), F.max("component").alias("d"))
    at = written(at.join(mixed.where("c <> d").select("key", "main"), "key"), "mixed-bands")
    a, b = at.alias("a"), at.where("component <> main").alias("b")
    rest = a.join(b, F.col("a.key") == F.col("b.key")).where("a.component <> b.component").where(sized(F.col("a.n"), F.col("b.n")))
    rest = rest.select(F.least("a.rep", "b.rep").alias("src"), F.greatest("a.rep", "b.rep").alias("dst")).where("src <> dst")
    rest = written(rest.distinct().join(led, ["src", "dst"], "left_anti"), "rest-pairs")
    second = _verified(texts, rest, width, similarity)
    # Ids that repeat with different texts belong to the groups of all of them.
    own = rows.select("id", "same").join(reps.select("same", "rep"), "same").select("id", "rep")
    groups = connected_components(first.union(second)).withColumnRenamed("node", "rep")
    return own.join(groups, "rep", "left").select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("component_id"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity=SIMILARITY, groups: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group does: that of the smallest id.

    ``groups`` are those of ``near_duplicates`` (SimHash), or by default documents with a Jaccard similarity of their word shingles of at least
    ``similarity``, verified for each link; null and wordless texts are equal.  Of repeated rows with one id, one stays; rows with a null id stay.
    """
    groups = jaccard_groups(docs, id_col, text_col, width, similarity) if groups is None else groups
    keep = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).cast("long").alias("__keep")).distinct()
    kept = docs.join(keep, F.col(id_col).cast("long") == F.col("__keep"), "left_semi")
    turn = Window.partitionBy(id_col).orderBy(F.xxhash64(F.col(text_col)))
    kept = kept.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
