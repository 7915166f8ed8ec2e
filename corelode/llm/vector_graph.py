"""Near-duplicate vectors by a robust-pruned flat graph with range-expanding greedy search.

Within a label and a vector length, unit vectors are dealt to shards by centres; a shard of more than
SHARD_VECTORS members is dealt again, until none is left or a large part of its vectors link with each other.  A
vector's home is the cell of its nearest centre; it is also a member of the OVERLAP nearest cells
whose bisector with its home is within the link distance.  Two linked vectors meet in the home shard of each
but for the rare pair with more cells in between: recall is measured, not certain.
Each shard (of bounded size) builds candidate neighbours and prunes them robustly; the adjacency lists of a vector over
its shards are united.  In its home shard each vector is searched for greedily from the nearest of a few
medoids; from what is found the search widens along edges through all nodes in range.
Found pairs are verified in double precision, and recall is audited against brute force.

Vectors of one label with equal unit vectors are one node of the graph, that of their smallest id;
their number is counted into the links afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import ship, written
from corelode.llm.components import connected_components

MIN_COSINE = 0.98
#: Members above which a shard is dealt again, most cells it is dealt to, vectors for each cell that centres are fitted on.
SHARD_VECTORS, CELLS, SAMPLE_PER_CELL = 1000, 64, 8
#: Cells a vector is a member of, at most.
OVERLAP = 3
#: A shard whose sampled vectors link with this share of each other on average stays whole: its links are as many as its pairs.
BALL = 0.1
#: Rounds of dealing: about CELLS ** ROUNDS shards at most from one label.
ROUNDS = 10
#: Members of a shard that one task deals.
TASK_VECTORS = 20_000
#: Neighbours kept; an edge is pruned where a kept neighbour is nearer to the far end by ALPHA.
DEGREE, ALPHA, BEAM = 24, 1.2, 8
#: Medoids that a shard's search starts from, at most; vectors whose links are audited by brute force, at most.
ENTRIES, AUDITED = 16, 256
#: Groups of more equal vectors meet their members by broadcast: one row for at least so many members.
HOT_COPIES = 1000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``y``."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def centres(sample: np.ndarray, count: int, steps: int = 8) -> np.ndarray:
    """k-means centres, first the rows at even steps through the sample."""
    found = sample[np.unique(np.linspace(0, len(sample) - 1, count).astype(int))]
    for _ in range(steps):
        own = _apart(sample, found).argmin(axis=1)
        many = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], found)
    return found


def cells_of(x: np.ndarray, middles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of each row in the cell of its nearest centre and in the next ones whose bisector is in reach."""
    reach = np.sqrt(2 - 2 * MIN_COSINE) + 1e-9
    far = _apart(x, middles)
    own = far.argmin(axis=1)
    between = np.sqrt(_apart(middles, middles))
    near = far - far.min(axis=1, keepdims=True) <= 2 * reach * between[own]
    if len(middles) > OVERLAP:
        near &= far <= np.partition(far, OVERLAP - 1, axis=1)[:, [OVERLAP - 1]]
    near[np.arange(len(x)), own] = True
    row, cell = np.nonzero(near)
    return row, cell, own[row] == cell


def robust_prune(x: np.ndarray, at: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """For each of the rows ``at``, of its ``pool`` (rows by rising distance; -1 is none): those not much nearer
    to one kept before, DEGREE at most, -1 behind them."""
    there = pool >= 0
    y = x[np.where(there, pool, 0)]
    far = ((y - x[at][:, None, :]) ** 2).sum(axis=2)
    between = 2 - 2 * np.matmul(y, y.transpose(0, 2, 1))
    line, kept, alive = np.arange(len(at)), np.full((len(at), DEGREE), -1), there.copy()
    for turn in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        k = alive.argmax(axis=1)
        kept[some, turn] = pool[line[some], k[some]]
        alive[line, k] = False
        alive &= ALPHA**2 * between[line, k] > far
    return kept


def shard_graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned adjacency of one shard: candidates are the nearest rows and a few spread over the shard."""
    n = len(x)
    spread = np.unique(np.linspace(0, n - 1, min(n, DEGREE // 2)).astype(int))
    near, lists = min(n - 1, 2 * DEGREE), []
    for s in range(0, n, 256):
        at = np.arange(s, min(s + 256, n))
        like = x[at] @ x.T
        like[np.arange(len(at)), at] = -2
        best = np.argpartition(-like, near - 1, axis=1)[:, :near] if near else np.zeros((len(at), 0), int)
        pool = np.concatenate([best, np.broadcast_to(spread, (len(at), len(spread)))], axis=1)
        pool = np.sort(pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        pool[pool == at[:, None]] = -1
        far = np.where(pool >= 0, -np.take_along_axis(like, np.maximum(pool, 0), axis=1), 9.0)
        kept = robust_prune(x, at, np.take_along_axis(pool, np.argsort(far, axis=1, kind="stable"), axis=1))
        lists += [row[row >= 0] for row in kept]
    return lists


def _around(nodes: np.ndarray, start: np.ndarray, adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``nodes``, neighbour) of all edges of ``nodes``."""
    many = start[nodes + 1] - start[nodes]
    which = np.repeat(np.arange(len(nodes)), many)
    return which, adjacent[np.repeat(start[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


def range_search(x: np.ndarray, start: np.ndarray, adjacent: np.ndarray, entries: np.ndarray, asked: np.ndarray, least: float):
    """(which of ``asked``, row) of all rows found with cosine of at least ``least`` to the asked row.

    Greedy with a beam from the nearest entry for all asked rows at once, then along edges through
    rows in range.
    """
    seen = np.zeros((len(asked), len(x)), bool)
    first = entries[(x[asked] @ x[entries].T).argmax(axis=1)]
    who, node = np.arange(len(asked)), first
    like, done = (x[asked] * x[first]).sum(axis=1), np.zeros(len(asked), bool)
    seen[who, node] = True
    hits = [(who[like >= least], node[like >= least])]
    while not done.all():
        _, turn = np.unique(who[~done], return_index=True)  # rows are sorted by asked row, nearest first
        turn = np.flatnonzero(~done)[turn]
        done[turn] = True
        which, fresh = _around(node[turn], start, adjacent)
        by = who[turn][which]
        new = ~seen[by, fresh]
        by, fresh = by[new], fresh[new]
        seen[by, fresh] = True
        told = np.einsum("ij,ij->i", x[fresh], x[asked[by]])
        hits.append((by[told >= least], fresh[told >= least]))
        who, node, like, done = np.r_[who, by], np.r_[node, fresh], np.r_[like, told], np.r_[done, np.zeros(len(by), bool)]
        order = np.lexsort((-like, who))
        who, node, like, done = who[order], node[order], like[order], done[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < BEAM
        who, node, like, done = who[keep], node[keep], like[keep], done[keep]
    by, at = (np.concatenate(c) for c in zip(*hits, strict=True))
    found = [(by, at)]
    while len(by):
        which, fresh = _around(at, start, adjacent)
        spot = np.unique(by[which] * len(x) + fresh)
        by, at = spot // len(x), spot % len(x)
        new = ~seen[by, at]
        by, at = by[new], at[new]
        seen[by, at] = True
        near = np.einsum("ij,ij->i", x[at], x[asked[by]]) >= least
        by, at = by[near], at[near]
        found.append((by, at))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _fit(key, table):
    """The centres of one shard from a few of its vectors; none where it is one ball of links."""
    import pyarrow as pa

    x = np.array(table.sort_by("vec").column("x").to_pylist(), float)
    many = table.column("many")[0].as_py()
    ball = (x @ x.T >= MIN_COSINE).sum() - len(x) >= BALL * len(x) * (len(x) - 1)
    middles = centres(x, min(CELLS, -(-4 * many // SHARD_VECTORS)))[: 0 if ball else None]
    return pa.table({"label": pa.array([key[0].as_py()], table.schema.field("label").type), "shard": [key[1].as_py()], "middles": pa.array([middles.ravel().tolist()], pa.list_(pa.float64()))})


def _deal(batches: Iterator) -> Iterator:
    """Members with their cells; the rows of a shard come together, its centres first."""
    import pyarrow as pa

    at, middles = None, None
    for batch in batches:
        group, fits = batch.column(5).to_pylist(), batch.column(6)
        cuts = [0, *(k for k in range(1, len(group)) if group[k] != group[k - 1]), len(group)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and group[a] != at:
                at, middles = group[a], None
            if a < b and middles is None:
                middles = np.array(fits[a].as_py(), float)
                a += 1
            if a >= b:
                continue
            part = batch.slice(a, b - a)
            x = np.array(part.column(3).to_pylist(), float)
            row, cell, home = cells_of(x, middles.reshape(-1, x.shape[1]))
            got = part.take(pa.array(row, pa.int32()))
            shard = [f"{s}.{c}" for s, c in zip(got.column(1).to_pylist(), cell.tolist(), strict=True)]
            home = home & np.array(got.column(4).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(shard, pa.string()), got.column(2), got.column(3), pa.array(home)], names=["label", "shard", "vec", "x", "home"])


def _sized(members: DataFrame) -> DataFrame:
    return written(members.groupBy("label", "shard").agg(F.count("*").alias("many")), "shard-sizes")


def deal(rows: DataFrame) -> DataFrame:
    """Written (label, shard, vec, x, home): the shards that each of ``rows`` (vec, label, x) is a member of.

    Centres of a shard are fitted on CELLS * SAMPLE_PER_CELL of its vectors, chosen by the hash of their ids; all vectors are dealt.
    """
    members = rows.select("label", F.size("x").cast("string").alias("shard"), "vec", "x", F.lit(True).alias("home"))
    kinds, key = f"label {rows.schema['label'].dataType.simpleString()}, shard string", ["label", "shard"]
    members, done = written(members, "shard-members"), []
    for _ in range(ROUNDS):
        sizes = _sized(members)
        large = sizes.where(F.col("many") > SHARD_VECTORS)
        if large.isEmpty():
            break
        part = F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        picked = members.join(large, key).where(part * F.col("many") <= CELLS * SAMPLE_PER_CELL)
        fits = written(picked.select(*key, "vec", "x", "many").groupBy(*key).applyInArrow(_fit, f"{kinds}, middles array<double>"), "shard-centres")
        fits = fits.where(F.size("middles") > 0).join(sizes, key).withColumn("tasks", F.ceil(F.col("many") / TASK_VECTORS).cast("int"))
        if fits.isEmpty():
            break
        named = members.join(fits.select(*key, "tasks"), key, "left")
        done.append(named.where("tasks is null").drop("tasks"))
        group = lambda task: F.concat_ws("|", F.col("label").cast("string"), "shard", task.cast("string")).alias("group")
        moved = named.where("tasks is not null").select(*key, "vec", "x", "home", group(F.pmod(F.xxhash64("vec"), "tasks")), F.lit(None).cast("array<double>").alias("middles"))
        ahead = fits.select(*key, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "middles")
        none = [F.lit(None).cast("long").alias("vec"), F.lit(None).cast("array<double>").alias("x"), F.lit(True).alias("home")]
        ahead = ahead.select(*key, *none, group(F.col("task")), "middles")
        both = moved.union(ahead).repartition("group").sortWithinPartitions("group", F.col("middles").isNull())
        members = written(both.mapInArrow(_deal, f"{kinds}, vec long, x array<double>, home boolean"), "shard-members")
    for rest in done:
        members = members.union(rest)
    return members


def _build(key, table):
    import pyarrow as pa

    x, vec = np.array(table.column("x").to_pylist(), float), table.column("vec").to_numpy()
    return pa.table({"vec": pa.array(vec), "near": pa.array([vec[k].tolist() for k in shard_graph(x)], pa.list_(pa.int64()))})


def medoids(x: np.ndarray, most: int) -> np.ndarray:
    """Rows to enter a search by: the row nearest the mean of each of up to ``most`` cells, around rows picked farthest from those before."""
    if not len(x):
        return np.zeros(0, int)
    picked = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[picked[0]]
    cell = np.zeros(len(x), int)
    while len(picked) < min(most, len(x)):
        far = int(near.argmin())
        if near[far] >= 1 - 1e-12:
            break
        own = x @ x[far]
        cell[own > near] = len(picked)
        near = np.maximum(near, own)
        picked.append(far)
    out = []
    for k in np.unique(cell):
        at = np.flatnonzero(cell == k)
        out.append(at[(x[at] @ x[at].mean(axis=0)).argmax()])
    return np.unique(out)


def _search(key, members, graph):
    import pyarrow as pa

    members = members.sort_by("vec")
    vec, n = members.column("vec").to_numpy(), members.num_rows
    x = np.array(members.column("x").to_pylist(), float).reshape(n, -1)
    home = np.array(members.column("home").to_pylist(), bool)
    near = graph.column("near").combine_chunks()
    a = np.repeat(np.searchsorted(vec, graph.column("g_vec").to_numpy()), near.value_lengths().to_numpy())
    other = near.flatten().to_numpy()
    b = np.minimum(np.searchsorted(vec, other), max(n - 1, 0))
    there = vec[b] == other if n else np.zeros(0, bool)
    a, b = a[there], b[there]
    edges = np.unique(np.r_[a * n + b, b * n + a]) if n else np.zeros(0, np.int64)
    start, adjacent = np.searchsorted(edges, np.arange(n + 1) * n), edges % max(n, 1)
    entries = medoids(x, ENTRIES)
    src, dst, asked = [], [], np.flatnonzero(home)
    step = 100_000 // max(n, 1) + 1
    for s in range(0, len(asked), step):
        some = asked[s : s + step]
        by, at = range_search(x, start, adjacent, entries, some, MIN_COSINE)
        apart = some[by] != at
        src.append(vec[some[by[apart]]])
        dst.append(vec[at[apart]])
    flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (src, dst)]
    return pa.table({"src": pa.array(flat[0], pa.int64()), "dst": pa.array(flat[1], pa.int64())})


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that can link: label, id and vector not null, all components finite, norm not zero."""
    x = F.col("x")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where("vec is not null and label is not null and x is not null").where(fine & (F.size(x) > 0))


def _unit_keys(batches: Iterator) -> Iterator:
    """Each row with its unit vector, scaled first so that no square overflows."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        flat, many = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(many) - many
        flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), start), many)
        flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, start)), many) + 0.0
        unit = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], unit], names=["vec", "label", "unit"])


def copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """Written (vec, label, x, many) of the first vector of each group of equal ones, and (vec, rep) of the groups' members; x is the unit vector."""
    rows = usable(vectors, id_col, vector_col, label_col).groupBy("vec").agg(F.min(F.struct("label", "x")).alias("v")).select("vec", "v.*")
    label = rows.schema["label"].dataType.simpleString()
    keyed = written(rows.mapInArrow(_unit_keys, f"vec long, label {label}, unit array<double>"), "vectors")
    groups = keyed.groupBy("label", "unit").agg(F.min("vec").alias("rep"), F.count("*").alias("many"))
    groups = written(groups, "equal-vectors")
    key, named = ["label", "unit"], groups.select("label", "unit", "rep", "many")
    hot = keyed.select("vec", *key).join(F.broadcast(named.where(F.col("many") > HOT_COPIES).drop("many")), key, "left")
    few = hot.where("rep is null").drop("rep").join(named.where(F.col("many") <= HOT_COPIES).drop("many"), key)
    members = written(hot.where("rep is not null").select("vec", "rep").union(few.select("vec", "rep")), "members")
    return groups.select(F.col("rep").alias("vec"), "label", F.col("unit").alias("x"), "many"), members


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Written (src, dst): found pairs of different ids of one label with cosine of at least 0.98, in both directions."""
    rows, members = copies(vectors, id_col, vector_col, label_col)
    found = rep_links(rows.drop("many")).union(rows.where("many > 1").select("vec", "vec"))
    src, dst = (members.select(F.col("rep").alias(f"{c}_rep"), F.col("vec").alias(c)) for c in ("a", "b"))
    pairs = found.join(src, F.col("src") == F.col("a_rep")).join(dst, F.col("dst") == F.col("b_rep")).where("a <> b")
    return written(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), "all-links")


def rep_links(rows: DataFrame) -> DataFrame:
    """Written (src, dst) of the links among ``rows`` (vec, label, unit vector x), no two of them equal, in both directions."""
    dealt = deal(rows)
    shard_lists = dealt.groupBy("label", "shard").applyInArrow(_build, "vec long, near array<long>")
    united = written(shard_lists.groupBy("vec").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    graph = dealt.select(F.col("label").alias("g_label"), F.col("shard").alias("g_shard"), "vec").join(united, "vec")
    graph = graph.select("g_label", "g_shard", F.col("vec").alias("g_vec"), "near")
    found = dealt.groupBy("label", "shard").cogroup(graph.groupBy("g_label", "g_shard")).applyInArrow(_search, "src long, dst long")
    found = written(found, "vector-hits")
    both = found.union(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return written(both.distinct(), "vector-links")


def recall(vectors: DataFrame, found: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", every: int = 50) -> float:
    """Share of the true links of the vectors whose id is divisible by ``every`` that ``found`` holds, by brute force in blocks."""
    rows = usable(vectors, id_col, vector_col, label_col)
    asked = rows.where(F.col("vec") % every == 0).select(F.col("vec").alias("q"), "label", F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    true = rows.join(asked, "label").where("vec <> q").where(dot / norm("x") / norm("y") >= MIN_COSINE).select(F.col("q").alias("src"), F.col("vec").alias("dst"))
    true = written(true, "true-links")
    total = true.count()
    return true.join(found, ["src", "dst"]).count() / total if total else 1.0


def audit(rows: DataFrame, found: DataFrame, asked: int = AUDITED) -> float:
    """Share of the true links of ``asked`` of ``rows`` (vec, label, unit vector x), chosen by hash, that ``found`` holds; 1 without links.

    The asked vectors, a bounded number, go to all tasks; each compares them with all its rows in blocks.
    """
    picked = rows.orderBy(F.xxhash64("vec", F.lit(3)), "vec").limit(asked).select("vec", "label", "x").collect()
    if not picked:
        return 1.0
    groups: dict[tuple, tuple] = {}
    for vec, label, x in picked:
        groups.setdefault((label, len(x)), ([], []))
        groups[label, len(x)][0].append(vec)
        groups[label, len(x)][1].append(x)
    groups = {k: (np.array(v), np.array(x, float)) for k, (v, x) in groups.items()}

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vec, labels = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = batch.column(2).value_lengths().to_numpy()
            src, dst = [], []
            for (label, size), (ids, asked_x) in groups.items():
                at = np.flatnonzero((sizes == size) & np.array([v == label for v in labels], bool))
                for s in range(0, len(at), 4096):
                    own = at[s : s + 4096]
                    block = np.array(batch.column(2).take(pa.array(own)).to_pylist(), float)
                    q, r = np.nonzero(asked_x @ block.T >= MIN_COSINE)
                    apart = ids[q] != vec[own[r]]
                    src.append(ids[q[apart]])
                    dst.append(vec[own[r[apart]]])
            flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (src, dst)]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in flat], names=["src", "dst"])

    true = written(rows.select("vec", "label", "x").mapInArrow(told, "src long, dst long"), "audited-links")
    total = true.count()
    return true.join(found, ["src", "dst"], "left_semi").count() / total if total else 1.0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept, audited_recall) per input row; the last is the share of true links found in an audit of AUDITED vectors.

    Only vectors of one non-null label and one length are compared.  Null, empty or zero vectors and vectors with a
    null or non-finite component link with nothing and are kept.  Rows repeating an id count
    once, with the smallest label and vector among them that can link, and each get that id's result; a null id has null results; other columns are not read.
    """
    ship(vectors.sparkSession)
    firsts, members = copies(vectors, id_col, vector_col, label_col)
    found = rep_links(firsts.drop("many"))
    share = audit(firsts, found)
    many = firsts.select(F.col("vec").alias("dst"), "many")
    degree = found.join(many, "dst").groupBy(F.col("src").alias("rep")).agg(F.sum("many").alias("others"))
    groups = connected_components(found).withColumnRenamed("node", "rep")
    nodes = many.withColumnRenamed("dst", "rep").join(degree, "rep", "left").join(groups, "rep", "left")
    nodes = nodes.select("rep", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"))
    named = rows.join(members, "vec", "left").join(nodes, "rep", "left")
    return named.select(
        F.col("vec").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec").alias("component_id"),
        (F.coalesce("component", "vec") == F.col("vec")).alias("kept"),
        F.lit(share).alias("audited_recall"),
    )
