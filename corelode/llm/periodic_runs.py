"""Maximal periodic runs of words, by longest common extensions on a harmonic grid.

Texts are worked on in batches of whole texts.  A run of at least 12 words and two periods repeats six words at a
distance of its period, so only texts in which some six-word sequence comes twice (by a hash that can only take
others in, never leave one out) can hold a run.  Their words get suffix arrays, forwards and reversed, by prefix
doubling; the common prefixes of neighbours (Kasai's scan) with block minima answer how far two places agree in both
directions.  For each period p the places jp and (j+1)p are asked: each stretch of two periods holds such a pair, and the two extensions give its ends.
Of equal stretches the smallest period is the run's.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import byte_texts
from corelode.llm.spans import WORD_BYTES, chunks, spans

#: Bytes of text in a batch, if no text is longer, and grid places that are asked at once.
BATCH_BYTES, GRID = 8_000_000, 1_000_000
#: A run has at least so many words; so many consecutive words then match at its period's distance.
LEAST_WORDS, SEED_WORDS = 12, 6
_BLOCK = 32

_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_array(code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each in it); suffix ``i`` ends before ``end[i]``, a shorter one comes first."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    head = np.ones(n, bool)
    head[1:] = code[order[1:]] != code[order[:-1]]
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    step = 1
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, rank
        suffix = order[slots]
        later = suffix + step
        second = np.where(later < end[suffix], rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + second
        turn = np.argsort(key, kind="stable")
        order[slots], key = suffix[turn], key[turn]
        head[slots[1:]] = key[1:] != key[:-1]
        head[slots[:1]] = True
        rank[order[slots]] = np.maximum.accumulate(np.where(head, place, 0))[slots]
        step *= 2


class Extensions:
    """How far two places of a sequence agree from there on, each inside its own text."""

    def __init__(self, code: np.ndarray, end: np.ndarray):
        order, self.rank = suffix_array(code, end)
        prefix = self._neighbours(code.tolist(), end.tolist(), order.tolist(), self.rank.tolist())
        size = -(-max(1, len(prefix)) // _BLOCK)
        cells = np.zeros((size, _BLOCK), np.int32)
        cells.reshape(-1)[: len(prefix)] = prefix
        self.prefix = cells.reshape(-1)
        self.onward = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.upto = np.minimum.accumulate(cells, axis=1).reshape(-1)
        self.levels = [cells.min(axis=1)]
        while (width := 1 << len(self.levels)) <= size:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: size - width + 1], last[width // 2 : size - width // 2 + 1]))

    @staticmethod
    def _neighbours(code: list, end: list, order: list, rank: list) -> list:
        """Length of the common prefix of each suffix in order with the one before."""
        out, held = [0] * len(code), 0
        for i, at in enumerate(rank):
            if not at:
                held = 0
                continue
            j = order[at - 1]
            most = min(end[i] - i, end[j] - j)
            while held < most and code[i + held] == code[j + held]:
                held += 1
            out[at] = held
            if held:
                held -= 1
        return out

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from the places ``i`` and ``j`` (unlike) on."""
        a, b = self.rank[i], self.rank[j]
        first, last = np.minimum(a, b) + 1, np.maximum(a, b)
        low, high = first // _BLOCK, last // _BLOCK
        out = np.minimum(self.onward[first], self.upto[last])
        gap = high - low - 1
        for level, least in enumerate(self.levels):
            some = np.flatnonzero((gap >> level > 0) & (gap >> level < 2))
            out[some] = np.minimum(out[some], np.minimum(least[low[some] + 1], least[high[some] - (1 << level)]))
        same = np.flatnonzero(low == high)
        if len(same):
            at, until = first[same], last[same]
            least = self.prefix[at]
            for k in range(1, _BLOCK):
                least = np.minimum(least, self.prefix[np.minimum(at + k, until)])
            out[same] = least
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, start of its text) of all jp whose partner (j+1)p is in the text, in parts; p up to half the text."""
    for size, start in zip(sizes.tolist(), starts.tolist(), strict=True):
        low = 1
        while low <= size // 2:
            # Periods from ``low``: their places number about size / p each.
            high, held = low, 0
            while high <= size // 2 and (held == 0 or held + (size - 1) // high <= GRID):
                held += (size - 1) // high
                high += 1
            period = np.arange(low, high)
            count = (size - 1) // period
            each = np.repeat(period, count)
            turn = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            yield start + turn * each, each, np.full(len(each), start)
            low = high


def _gathered(parts: Iterator, most: int) -> Iterator:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def find_runs(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of texts laid end to end, by start, then period."""
    n, starts = len(code), np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    _, code = np.unique(text * (int(code.max(initial=0)) + 1) + code, return_inverse=True)
    code = code.astype(np.int64)
    end = np.repeat(starts + sizes, sizes)
    onward = Extensions(code, end)
    # Reversed: place i of the whole becomes n - 1 - i, texts end where they started.
    back = Extensions(np.ascontiguousarray(code[::-1]), n - np.repeat(starts, sizes)[::-1])
    found = []
    for i, period, start in _gathered(_grid(sizes, starts), GRID):
        j = i + period
        right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        some = np.flatnonzero(code[i] == code[j])
        right[some] = onward.agree(i[some], j[some])
        some = np.flatnonzero((i > start) & (code[i - 1] == code[j - 1]))
        left[some] = back.agree(n - i[some], n - j[some])
        run = np.flatnonzero((left + right >= period) & (left + right + period >= LEAST_WORDS))
        found.append(np.stack([i[run] - left[run], j[run] + right[run], period[run]], axis=1))
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _may_repeat(code: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Which texts hold a sequence of SEED_WORDS words twice, or one that has the same hash."""
    out = np.zeros(texts, bool)
    places = len(code) - SEED_WORDS + 1
    if places < 2:
        return out
    # Odd multipliers of a 64-bit mixing hash.
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = text[:places].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(SEED_WORDS):
        key = (key ^ mixed[k : k + places]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    inside = np.flatnonzero(text[:places] == text[SEED_WORDS - 1 :])
    key = key[inside]
    order = np.argsort(key)
    twice = key[order[1:]] == key[order[:-1]]
    out[text[inside[order[1:][twice]]]] = True
    return out


def _sources(ids: list, size: np.ndarray, start: np.ndarray, planted: bool) -> np.ndarray:
    """Place of the word that each word becomes; see ``periodic_runs``."""
    out = np.arange(int(size.sum()))
    for k, i in enumerate(ids if planted else []):
        if i is None or not size[k]:
            continue
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            n, g, lo = int(size[k]), h // 10, int(start[k])
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return out


def _read(batches: Iterator, planted: bool) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = [pa.int64()] * 5 + [pa.string()] * 2
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    for batch in batches:
        texts, ids = byte_texts(batch.column(1)), batch.column(0).to_pylist()
        for part in chunks(texts, BATCH_BYTES):
            rows = texts[part]
            words, text = spans(rows, WORD_BYTES)
            size = np.bincount(text, minlength=len(rows)).astype(np.int64)
            start = np.cumsum(size) - size
            source = _sources(ids[part], size, start, planted)
            code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)[source] if len(words) else np.zeros(0, np.int32)
            may = np.flatnonzero(_may_repeat(code, text, len(rows)))
            runs = find_runs(code[np.isin(text, may)], size[may]) if len(may) else np.zeros((0, 3), np.int64)
            inner = np.cumsum(size[may]) - size[may]
            owner = np.searchsorted(inner, runs[:, 0], "right") - 1 if len(runs) else np.zeros(0, np.int64)
            bounds = np.searchsorted(owner, np.arange(len(may) + 1))
            kept = np.ones(len(code), bool)
            told = [(0, None, None, None, None, hashlib.sha256(b"").hexdigest())] * len(rows)
            for m, t in enumerate(may.tolist()):
                own = runs[bounds[m] : bounds[m + 1]] - [inner[m], inner[m], 0]
                if not len(own):
                    continue
                for s, e, p in own.tolist():
                    kept[start[t] + s + p : start[t] + e] = False
                length = own[:, 1] - own[:, 0]
                b = np.lexsort((own[:, 2], own[:, 0], -length))[0]
                lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in own.tolist())
                told[t] = (len(own), int(own[b, 0]), int(length[b]), int(own[b, 2]), int(1000 * length[b] // own[b, 2]), hashlib.sha256(lines.encode()).hexdigest())
            left = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(np.bincount(text[kept], minlength=len(rows)), out=left[1:])
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words.take(pa.array(source[kept]))), pa.scalar(b" ", pa.large_binary()))
            collapsed = [hashlib.sha256(v.as_buffer()).hexdigest() for v in joined]
            columns = [*zip(*told, strict=True), collapsed]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(rows)), *[pa.array(c, k) for c, k in zip(columns, kind, strict=True)]], names=["id", *names])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """One row per input row: id, number of runs, the longest run, and digests of all runs and of the text without repeats.

    ``planted`` makes the texts whose id's crc32 is divisible by ten periodic from some word on, as a test of whole texts; a null
    id's text stays as it is.  Null, empty and blank texts have no words and no runs; equal rows give equal results; an empty table gives none;
    other columns are not read.  No shuffle: a task holds one batch of texts, or one longer text with about 150 bytes a word.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _read(it, planted), f"id {kind}, {_SCHEMA}")
    return found.withColumnRenamed("id", id_col)
