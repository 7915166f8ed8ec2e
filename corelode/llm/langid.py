"""Language identification by a linear-chain conditional random field over words.

Emissions: hashed affixes, character trigrams, the whole word and membership in learned lexicons;
transitions between labels are learned with them, by gradient ascent on the chain likelihood, from chains of
one language and chains that switch between pieces of several.
A whole text is one chain: forward-backward labels every word, so code-switched texts get word posteriors; a document's
language is the label with the largest mean posterior over all its words.  To work on many texts at once, chains are
cut into pieces of equal length, whose transfer matrices carry the exact messages across the cuts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelode.llm.common import remainder, ship, trimmed

#: Bounds of the training sample: texts of each language, by smallest hash of the id, whatever their length; lexicon words of each.
SAMPLE_PER_LANGUAGE = 300
LEXICON_WORDS = 400
WEIGHT_ROWS = 1 << 16
#: Words of a piece of a chain, and of a training chain.
CHAIN_WORDS = 64
EPOCHS = 4
MEMO_WORDS = 400_000
UNDETERMINED = "und"


@dataclass
class Tagger:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, list[int]]
    rows: dict[str, int] = field(default_factory=dict)
    emitted: np.ndarray | None = None

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "transitions": self.transitions, "lexicon": self.lexicon, "rows": {}, "emitted": None}

    def emissions(self, features: list[list[int]]) -> np.ndarray:
        many = np.fromiter(map(len, features), np.int64, len(features))
        if not len(features):
            return np.zeros((0, len(self.labels)), np.float32)
        flat = np.fromiter((x for fs in features for x in fs), np.int64, int(many.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(many) - many, axis=0)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``emitted``; words without a letter give -1."""
        if len(self.rows) > MEMO_WORDS:
            self.rows.clear()
            self.emitted = None
        missing = [w for w in set(words).difference(self.rows)]
        if missing:
            lettered = [w for w in missing if any(map(str.isalpha, w))]
            base = 0 if self.emitted is None else len(self.emitted)
            fresh = self.emissions([word_features(w, self.lexicon) for w in lettered])
            self.emitted = fresh if self.emitted is None else np.concatenate([self.emitted, fresh])
            self.rows.update(dict.fromkeys(missing, -1))
            self.rows.update(zip(lettered, range(base, base + len(lettered)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed word posteriors, lettered words) of each text."""
        if not self.labels:
            return np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64)
        split = [t.lower().split() for t in texts]
        rows = self.lookup([w for ws in split for w in ws])
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])[rows >= 0]
        rows = rows[rows >= 0]
        total, many = np.zeros((len(texts), len(self.labels))), np.bincount(owner, minlength=len(texts))
        if len(rows):
            first = np.cumsum(many) - many
            place = np.arange(len(rows)) - first[owner]
            pieces = -(-many // CHAIN_WORDS)
            start = np.cumsum(pieces) - pieces
            grid = np.full((int(pieces.sum()), CHAIN_WORDS), -1)
            grid[start[owner] + place // CHAIN_WORDS, place % CHAIN_WORDS] = rows
            gamma = whole_chains(self.emitted, self.transitions, grid, start, pieces)
            np.add.at(total, np.repeat(np.arange(len(texts)), pieces), gamma.sum(axis=1))
        return total, many


def word_features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Hashed features of a lower-cased word."""
    core = "".join(filter(str.isalpha, word))
    held = f"^{core}$"
    names = [f"w:{core}", *(f"p:{core[:k]}" for k in (1, 2, 3)), *(f"s:{core[-k:]}" for k in (1, 2, 3))]
    names += [held[k : k + 3] for k in range(len(held) - 2)]
    names += [f"lexicon:{k}" for k in lexicon.get(core, ())]
    crc, mask = zlib.crc32, WEIGHT_ROWS - 1
    return [crc(x.encode()) & mask for x in names]


def _potentials(emitted: np.ndarray, transitions: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    there = grid >= 0
    scores = np.where(there[:, :, None], emitted[grid], 0.0)
    return there, np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions - transitions.max())


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def forward_backward(emitted: np.ndarray, transitions: np.ndarray, grid: np.ndarray, before=None, after=None, first=None, counts: bool = True):
    """(posteriors chains x words x labels, expected transitions) of chains of emission rows; -1 pads at the end.

    Pieces of longer chains have messages ``before`` and ``after`` them and tell which are ``first``.
    """
    n, steps = grid.shape
    labels = transitions.shape[0]
    there, local, step = _potentials(emitted, transitions, grid)
    alpha, beta = np.empty((n, steps, labels)), np.empty((n, steps, labels))
    now = np.full((n, labels), 1.0 / labels) if before is None else before
    begun = np.ones(n, bool) if first is None else first
    for t in range(steps):
        moved = now @ step
        if t == 0:
            moved = np.where(begun[:, None], now, moved)
        now = np.where(there[:, t, None], _scaled(moved * local[:, t], 1), now)
        alpha[:, t] = now
    now = np.ones((n, labels)) if after is None else after
    expected = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        beta[:, t] = now
        if t:
            later = now * local[:, t]
            if counts:
                joint = alpha[:, t - 1, :, None] * step * later[:, None, :]
                joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
                expected += (joint * there[:, t, None, None]).sum(axis=0)
            now = np.where(there[:, t, None], _scaled(later @ step.T, 1), now)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
    return gamma * there[:, :, None], expected


def whole_chains(emitted: np.ndarray, transitions: np.ndarray, grid: np.ndarray, start: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Posteriors of whole chains, each of ``pieces`` rows of the grid from ``start``: exact across the cuts."""
    labels = transitions.shape[0]
    there, local, step = _potentials(emitted, transitions, grid)
    first = np.zeros(len(grid), bool)
    first[start[pieces > 0]] = True
    long = np.flatnonzero(np.repeat(pieces, pieces) > 1)
    transfer = np.zeros((len(grid), labels, labels))
    if len(long):
        own = np.broadcast_to(np.eye(labels), (len(long), labels, labels))
        for t in range(grid.shape[1]):
            moved = own @ step
            if t == 0:
                moved = np.where(first[long][:, None, None], own, moved)
            own = np.where(there[long, t, None, None], _scaled(moved * local[long, t][:, None, :], (1, 2)), own)
        transfer[long] = own
    before, after = np.full((len(grid), labels), 1.0 / labels), np.ones((len(grid), labels))
    for k in range(1, int(pieces.max(initial=0))):
        at = start[pieces > k] + k
        before[at] = _scaled(np.einsum("ni,nij->nj", before[at - 1], transfer[at - 1]), 1)
    for k in range(int(pieces.max(initial=0)) - 1, 0, -1):
        at = start[pieces > k] + k
        after[at - 1] = _scaled(np.einsum("nij,nj->ni", transfer[at], after[at]), 1)
    return forward_backward(emitted, transitions, grid, before, after, first, counts=False)[0]


def training_chains(texts: list[tuple[int, list[str]]], draw: np.random.Generator) -> list[list[tuple[int, list[str]]]]:
    """Chains of CHAIN_WORDS words as pieces (label, words): every text in order, and once more in short pieces put together at random."""
    whole = [[(k, ws[s : s + CHAIN_WORDS])] for k, ws in texts for s in range(0, len(ws), CHAIN_WORDS)]
    short = [(k, ws[s : s + CHAIN_WORDS // 4]) for k, ws in texts for s in range(0, min(len(ws), 2 * CHAIN_WORDS), CHAIN_WORDS // 4)]
    order = draw.permutation(len(short)).tolist()
    return whole + [[short[j] for j in order[s : s + 4]] for s in range(0, len(order), 4)]


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = 0.3, batch: int = 256, seed: int = 7) -> Tagger:
    """A tagger from (language, text) pairs; each word of a text is taken to be of its language."""
    labels = sorted({lang for lang, _ in samples})
    seen = {lang: Counter() for lang in labels}
    texts: list[tuple[int, list[str]]] = []
    for lang, text in samples:
        words = [w for w in text.lower().split() if any(map(str.isalpha, w))]
        seen[lang].update({"".join(filter(str.isalpha, w)) for w in words})
        texts.append((labels.index(lang), words))
    draw = np.random.default_rng(seed)
    chains = training_chains(texts, draw)
    lexicon: dict[str, list[int]] = {}
    for k, lang in enumerate(labels):
        for w, c in seen[lang].most_common(LEXICON_WORDS):
            if c >= 5 and c >= 0.8 * sum(s[w] for s in seen.values()):
                lexicon.setdefault(w, []).append(k)
    count = max(1, len(labels))
    model = Tagger(labels, np.zeros((WEIGHT_ROWS, count), np.float32), np.zeros((count, count)), lexicon)
    if not chains:
        return model
    index = {w: k for k, w in enumerate(dict.fromkeys(w for pieces in chains for _, ws in pieces for w in ws))}
    features = [word_features(w, lexicon) for w in index]
    grid, gold = np.full((len(chains), CHAIN_WORDS), -1), np.zeros((len(chains), CHAIN_WORDS), np.int64)
    for k, pieces in enumerate(chains):
        at = 0
        for label, ws in pieces:
            grid[k, at : at + len(ws)], gold[k, at : at + len(ws)] = [index[w] for w in ws], label
            at += len(ws)
    squares, moved = np.full_like(model.weights, 1e-3), np.full((count, count), 1e-3)
    for _ in range(epochs):
        order = draw.permutation(len(chains))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            part, words = grid[pick], np.unique(grid[pick][grid[pick] >= 0])
            local = np.where(part >= 0, np.searchsorted(words, np.maximum(part, 0)), -1)
            own = [features[w] for w in words.tolist()]
            gamma, expected = forward_backward(model.emissions(own), model.transitions, local)
            there = part >= 0
            target = (gold[pick][:, :, None] == np.arange(count)) & there[:, :, None]
            by_word = np.zeros((len(words), count))
            np.add.at(by_word, local[there], (target - gamma)[there])
            many = [len(x) for x in own]
            gradient = np.zeros_like(model.weights)
            np.add.at(gradient, np.concatenate(own), np.repeat(by_word, many, axis=0).astype(np.float32))
            gradient = gradient / len(pick) - 1e-6 * model.weights
            squares += gradient**2
            model.weights += rate * gradient / np.sqrt(squares)
            pairs = (gold[pick][:, :-1] * count + gold[pick][:, 1:])[there[:, 1:]]
            step = (np.bincount(pairs, minlength=count * count).reshape(count, count) - expected) / len(pick) / CHAIN_WORDS
            moved += step**2
            model.transitions = np.clip(model.transitions + rate * step / np.sqrt(moved), -4, 4)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Tagger:
    """A tagger fitted on a bounded sample: ``per_language`` texts of each language, whole, by smallest hash of the id.

    Rows whose crc32(id as text) mod 3 is 1 are held out; so are rows without a text or a language.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (remainder(id_col, 3) != 1))
    chance = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    small = rows.select(F.col(lang_col).alias("__lang"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), chance.alias("__chance"))
    # Only rows whose hash can be among the smallest are ranked, without their texts.
    sizes = small.groupBy(F.col("__lang").alias("__l")).agg(F.count("*").alias("__n"))
    near = small.join(sizes, F.col("__lang") == F.col("__l")).where(F.col("__chance") <= (2 * per_language + 100) * float(1 << 30) / F.col("__n"))
    turn = Window.partitionBy("__lang").orderBy("__chance", "__id", "__text")
    picked = near.withColumn("__turn", F.row_number().over(turn)).where(F.col("__turn") <= per_language).select("__id", "__text")
    told = rows.join(picked.distinct(), (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__text")), "left_semi")
    told = told.select(lang_col, text_col).distinct().orderBy(lang_col, text_col)
    return train([(r[0], r[1]) for r in told.collect()])


def _predict(batches: Iterator, model, inside: str | None) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    tagger = model.value
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            texts = [t or "" for t in (pc.struct_field(part.column(0), inside) if inside else part.column(1)).to_pylist()]
            total, many = tagger.posteriors(texts)
            best = total.argmax(axis=1)
            names, scores = [], []
            for t, k, n, row in zip(texts, best.tolist(), many.tolist(), total, strict=True):
                known = n > 0 and bool(tagger.labels)
                names.append(tagger.labels[k] if known else UNDETERMINED)
                scores.append(min(1.0, float(row[k]) / n) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"]
            )


def predict(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text", inside: bool = False) -> DataFrame:
    """(id, lang_pred, score) per input row, from the text alone; with ``inside`` the text is a field of the id, a struct, and is sent once.

    A null text or one without any letter gives ``und`` with score 0, as does every text when nothing
    could be learned; score is the mean posterior of the predicted language over all words of the
    text.  Repeated rows give repeated results; other columns are not read.  No shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WEIGHT_ROWS x languages floats
    rows = docs.select(F.col(id_col).alias("id"), *([] if inside else [F.col(text_col).alias("t")]))
    found = rows.mapInArrow(lambda it: trimmed(_predict(it, shared, text_col if inside else None)), f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)
