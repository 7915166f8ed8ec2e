"""How far the sources of a language differ in the terms they use, by sorted streams.

Each task counts the terms of its documents by a run-length scan over (lang, term, source, document): a document is one
row, so its run ends inside the task, and the counts and document frequencies that leave the task are sums.  They are
dealt by (lang, term), sorted by (lang, term, source) and scanned again as a stream: a run over one term gives its
document frequency and its counts by source.  The runs of kept terms are written once, then joined with the totals of
their groups and streamed a second time for the partial sums of pairs and the terms of each group.

Two groups are compared over all kept terms without a row for absent ones.  With p(s) the value of a term in group s and
z(s) that of a term it lacks, |p(s) - p(t)| summed over V terms is V |z(s) - z(t)|, plus |p - z(t)| - |z(s) - z(t)| over
the terms of s and the like over those of t (from counts of equal p), plus a correction for the terms that both have,
which the stream adds up for all pairs of sources of a run in arrays of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.llm.common import byte_texts, written
from corelode.llm.spans import TERM_BYTES, chunks, spans

#: Bytes of text that one scan of a task holds, if no text is longer.
CHUNK_BYTES = 16_000_000
#: Sources whose pair sums are held as one array.
PAIR_BLOCK = 512
#: Share of a group: parts in a thousand million, counts smoothed by 5.
SCALE, SMOOTH = 1_000_000_000, 5

_COUNTS = "lang string, term string, source string, n long, df long"
_CELLS = "lang string, term string, source string, n long, total long, head long"
_PARTS = "lang string, source string, part string, item string, value long"


def _text_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _counted(batches: Iterator) -> Iterator:
    """(lang, term, source, n, df) of the texts of each chunk; columns: lang, source, text."""
    import pyarrow as pa

    for batch in batches:
        texts = byte_texts(batch.column(2))
        for part in chunks(texts, CHUNK_BYTES):
            rows = texts[part]
            langs, sources = (batch.column(k).slice(part.start, len(rows)).dictionary_encode() for k in (0, 1))
            group = langs.indices.to_numpy() * np.int64(len(sources.dictionary)) + sources.indices.to_numpy()
            words, doc = spans(rows, TERM_BYTES, lower=True)
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # One run for each document and term, then one for each group and term.
            pairs, n = np.unique(code * len(rows) + doc, return_counts=True)
            code, doc = pairs // len(rows), pairs % len(rows)
            key = group[doc] * max(1, len(coded.dictionary)) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            if not len(start):
                continue
            key, total = key[start], np.add.reduceat(n[order], start)
            held, term = key // len(coded.dictionary), key % len(coded.dictionary)
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(held // len(sources.dictionary))),
                coded.dictionary.take(pa.array(term)).cast(pa.binary()).cast(pa.string()),
                sources.dictionary.take(pa.array(held % len(sources.dictionary))),
                pa.array(total), pa.array(np.diff(start, append=len(order))),
            ], names=["lang", "term", "source", "n", "df"])


def _changes(table, names: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns; true for the first."""
    import pyarrow.compute as pc

    changed = np.zeros(table.num_rows, bool)
    changed[:1] = True
    for name in names:
        column = table.column(name).combine_chunks()
        if table.num_rows > 1:
            changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
    return changed


def _whole_runs(batches: Iterator) -> Iterator:
    """Tables of a stream sorted by (lang, term, ...) that never end inside the run of a term."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        last = int(np.flatnonzero(_changes(table, ["lang", "term"]))[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held = _merged(table.slice(last).combine_chunks()) if "df" in table.column_names else table.slice(last)
    if held is not None:
        yield held


def _merged(table):
    """One row for each (lang, term, source) of a sorted table of counts."""
    import pyarrow as pa

    start = np.flatnonzero(_changes(table, ["lang", "term", "source"]))
    kept = table.take(pa.array(start))
    for name in ("n", "df"):
        kept = kept.set_column(kept.schema.get_field_index(name), name, pa.array(np.add.reduceat(table.column(name).to_numpy(), start)))
    return kept


def _kept(batches: Iterator, least: int) -> Iterator:
    """Cells of the terms that ``least`` documents of their language hold; ``head`` is 1 in the first of each term."""
    import pyarrow as pa

    for table in _whole_runs(batches):
        table = _merged(table)
        start = np.flatnonzero(_changes(table, ["lang", "term"]))
        size = np.diff(start, append=table.num_rows)
        df, total = (np.add.reduceat(table.column(c).to_numpy(), start) for c in ("df", "n"))
        head = np.zeros(table.num_rows, np.int64)
        head[start] = 1
        table = table.drop(["df"]).append_column("total", pa.array(np.repeat(total, size))).append_column("head", pa.array(head))
        yield from table.filter(pa.array(np.repeat(df >= least, size))).combine_chunks().to_batches()


def _correction(p, z, q, y):
    """What |p - q| over a term of both groups adds to the sums that take the other group's value as that of an absent term."""
    p, z = p[:, None], z[:, None]
    return np.abs(p - q) - np.abs(p - y) - np.abs(z - q) + np.abs(z - y)


def _audited(batches: Iterator) -> Iterator:
    """Rows of ``_PARTS``: partial corrections of pairs (one order of each) and the terms above their language's share."""
    import pyarrow as pa

    lang, codes, sums = None, {}, np.zeros((PAIR_BLOCK, PAIR_BLOCK), np.int64)

    def told(lang: str, left: list[str], right: list[str], values: np.ndarray):
        a, b = np.nonzero(values)
        columns = [pa.array([lang] * len(a), pa.string()), pa.array(left, pa.string()).take(pa.array(a)), pa.array(["pair"] * len(a), pa.string()), pa.array(right, pa.string()).take(pa.array(b)), pa.array(values[a, b])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    def flushed():
        names = list(codes)
        out = told(lang, names, names, np.triu(sums[: len(names), : len(names)] + sums[: len(names), : len(names)].T, 1))
        codes.clear()
        sums[:] = 0
        return out

    for table in _whole_runs(batches):
        start = np.flatnonzero(_changes(table, ["lang", "term"]))
        langs, terms = (table.column(c).combine_chunks().take(pa.array(start)).to_pylist() for c in ("lang", "term"))
        sources = table.column("source").to_pylist()
        p, z, q = (table.column(c).to_numpy() for c in ("p", "z", "q"))
        over = np.flatnonzero(p > q)
        yield from pa.table({
            "lang": table.column("lang").take(pa.array(over)), "source": table.column("source").take(pa.array(over)), "part": pa.array(["term"] * len(over), pa.string()),
            "item": table.column("term").take(pa.array(over)), "value": pa.array((p - q)[over]),
        }).combine_chunks().to_batches()
        for run, (at, end) in enumerate(zip(start, [*start[1:], table.num_rows], strict=True)):
            if end - at < 2:
                continue
            if codes and (langs[run] != lang or len(codes) + end - at > PAIR_BLOCK):
                yield flushed()
            lang = langs[run]
            if end - at <= PAIR_BLOCK:
                own = np.array([codes.setdefault(s, len(codes)) for s in sources[at:end]])
                sums[own[:, None], own] += np.triu(_correction(p[at:end], z[at:end], p[at:end], z[at:end]), 1)
                continue
            for a in range(at, end, PAIR_BLOCK):
                for b in range(a, end, PAIR_BLOCK):
                    i, j = slice(a, min(end, a + PAIR_BLOCK)), slice(b, min(end, b + PAIR_BLOCK))
                    values = _correction(p[i], z[i], p[j], z[j])
                    yield told(lang, sources[i], sources[j], np.triu(values, 1) if a == b else values)
    if codes:
        yield flushed()


def _share(count: str, n: str = "held", v: str = "V") -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (n + SMOOTH v)), exact for any long; null without terms."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"if({v} > 0, 1 + ({wide(count)} + {SMOOTH}) * {SCALE} div ({wide(n)} + {SMOOTH} * {wide(v)}), null)")


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): see the module.

    Null text, lang and source count as empty; each row is a document, repeated rows too; other columns are not
    read.  A group without kept terms is compared with the others of its language all the same; equal values rank
    by the bytes of the item; an empty table gives no rows.  A text longer than a chunk is scanned alone, whole.
    """
    rows = docs.select(_text_column(lang_col).alias("lang"), _text_column(source_col).alias("source"), _text_column(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, _COUNTS)
    runs = counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    cells = written(runs.mapInArrow(lambda it: _kept(it, least), _CELLS), "divergence-cells")

    # Totals: one row for each language, one for each group that occurs.
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("head").alias("V"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("V", F.lit(0)).alias("V"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    groups = written(groups.withColumn("z", _share("cast(0 as long)")), "divergence-groups")

    valued = cells.join(groups, ["lang", "source"]).select("lang", "term", "source", _share("n").alias("p"), "z", _share("total", "lang_n").alias("q"))
    audited = valued.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    parts = written(audited.mapInArrow(_audited, _PARTS), "divergence-parts")

    # Each group against the others of its language: all terms as if absent, then its own terms, then the corrections.
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    absent = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("V") * F.abs(F.col("z") - F.col("y")), F.lit(0)).alias("value"))
    equal = valued.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("k"))
    own = equal.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("k") * (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("z") - F.col("y")))).alias("value"))
    own = own.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = own.union(parts.where("part = 'pair'").select("lang", "source", "item", "value"))
    turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = absent.union(both).union(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = parts.where("part = 'term'").select("lang", "source", "item", "value")
    turn = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda found, part: found.select("lang", "source", F.lit(part).alias("part"), "item", "value", turn.alias("rank"))
    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))
