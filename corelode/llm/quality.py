"""Quality classification by co-training of a text-content view and a page-metadata view.

Two logistic classifiers, one on what a text holds and one on what is known about its page, start
from labelled documents.  In each round either classifies all documents and hands those that it is sure of, as
pseudo-labels, to the other, which takes a Newton step on the labelled documents and on
gradient and curvature summed over all that were handed to it.  Each view is then calibrated on labelled
documents kept aside, and a weighting of the calibrated log-odds, learned there too, gives the
score of every document.  The same is done for two targets: quality and toxicity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelode.llm.common import gathered, ship, trimmed

#: Bound of the sample of labelled documents of each (quality, toxic) pair, whatever the length of their texts.
LABELLED_PER_CLASS = 700
#: Rounds over all documents; log-odds beyond which a view is sure; weight of each class of pseudo-labels, labelled documents together being 1.
ROUNDS = 2
SURE = 2.0
HANDED_WEIGHT = 0.25
RIDGE = 1e-2
#: Words whose presence tells a target, at most, and the documents in which each must occur.
TELLING_WORDS = 48
TELLING_SUPPORT = 8
TELLING_SHARE = 0.04
META_BUCKETS = 32
_SYMBOLS = b"#$%&*|@~^<>{}[]\\=+_"


def text_basics(raw: bytes) -> list[float]:
    """Shape of a text: shares of character kinds, word and line repetition, lengths."""
    n = len(raw)
    if not n:
        return [0.0] * 11
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = raw.split(b"\n")
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()
    return [
        float(np.log1p(len(words))),
        float(letters / n),
        float(counts[65:91].sum() / max(1, letters)),
        float(counts[48:58].sum() / n),
        float(counts[list(_SYMBOLS)].sum() / n),
        float((counts[33] + counts[63]) / n),
        float(counts[10] / n),
        float(n / max(1, len(words)) / 10),
        float(len(set(words)) / max(1, len(words)) if len(words) else 0.0),
        float(len(set(lines)) / len(lines)),
        float(np.log1p(max(map(len, words), default=0))),
    ]


def _words(raw: bytes) -> set[bytes]:
    return {w.strip(b".,!?;:\"'()") for w in raw.lower().split()}


def meta_basics(values: list) -> np.ndarray:
    """Hashed page metadata: each text value sets one of the buckets of its column, each number gives its logarithm."""
    row = np.zeros(len(values) * META_BUCKETS)
    for k, v in enumerate(values):
        if v is None:
            row[k * META_BUCKETS] = 1.0
        elif isinstance(v, str):
            row[k * META_BUCKETS + 2 + zlib.crc32(v.encode()) % (META_BUCKETS - 2)] = 1.0
        else:
            row[k * META_BUCKETS + 1] = np.log1p(abs(float(v))) / 10 if np.isfinite(float(v)) else 0.0
    return row


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias

    def slopes(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the weighted log-likelihood in (weights, bias)."""
        z = np.c_[((x - self.mean) / self.scale).clip(-8, 8), np.ones(len(x))]
        p = 1 / (1 + np.exp(-(z @ np.r_[self.weights, self.bias]).clip(-30, 30)))
        return z.T @ (share * (y - p)), (z * (share * p * (1 - p))[:, None]).T @ z

    def moved(self, gradient: np.ndarray, curve: np.ndarray) -> Linear:
        now = np.r_[self.weights, self.bias]
        now = now + np.linalg.solve(curve + RIDGE * np.eye(len(now)), gradient - RIDGE * now)
        return Linear(self.mean, self.scale, now[:-1], float(now[-1]))


def _shares(y: np.ndarray) -> np.ndarray:
    """Weights that make both classes count alike and sum to one."""
    return np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> Linear:
    """Ridge logistic regression by Newton steps, classes weighted alike."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.c_[((x - mean) / scale).clip(-8, 8), np.ones(len(x))]
    share = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
        gradient = z.T @ (share * (y - p)) / len(y) - ridge * w
        curve = (z * (share * p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


@dataclass
class Target:
    telling: list[bytes]
    text: Linear
    meta: Linear
    calibrated: tuple[tuple[float, float], tuple[float, float]]
    combined: Linear

    def inputs(self, basics: np.ndarray, words: list[set[bytes]]) -> np.ndarray:
        hits = np.array([[float(t in ws) for t in self.telling] for ws in words]).reshape(len(words), len(self.telling))
        return np.c_[basics, hits, hits.sum(axis=1)]

    def scores(self, basics: np.ndarray, words: list[set[bytes]], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (a, b), (c, d) = self.calibrated
        text = a * self.text.odds(self.inputs(basics, words)) + b
        page = c * self.meta.odds(meta) + d
        return tuple(1 / (1 + np.exp(-v.clip(-30, 30))) for v in (text, page, self.combined.odds(np.c_[text, page])))


def telling_words(words: list[set[bytes]], y: np.ndarray) -> list[bytes]:
    """Words far more frequent in documents of the rarer class, or in those of the other."""
    yes, no = Counter(), Counter()
    for ws, v in zip(words, y.tolist(), strict=True):
        (yes if v > 0.5 else no).update(ws)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    least = max(TELLING_SUPPORT, TELLING_SHARE * n1)
    gain = {w: np.log((c + 0.5) / n1 / ((no[w] + 0.5) / n0)) for w, c in yes.items() if c >= least}
    return sorted((w for w, g in gain.items() if g > 1.5), key=lambda w: (-gain[w] * yes[w], w))[:TELLING_WORDS]


def _aside(n: int, seed: int = 3) -> np.ndarray:
    """A quarter of the labelled documents, for calibration."""
    aside = np.zeros(n, bool)
    aside[np.random.default_rng(seed).permutation(n)[: n // 4]] = True
    return aside


def begin(basics, words, meta, y, rare: float) -> Target:
    """Both views of one target from labelled documents; ``rare`` is the class (0 or 1) whose telling words are looked for."""
    fitted = ~_aside(len(y))
    telling = telling_words([w for w, k in zip(words, fitted, strict=True) if k], np.abs(1 - rare - y[fitted]))
    target = Target(telling, None, None, ((1.0, 0.0), (1.0, 0.0)), None)
    target.text = logistic(target.inputs(basics, words)[fitted], y[fitted])
    target.meta = logistic(meta[fitted], y[fitted])
    return target


def _handed(target: Target, text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
    """For each view and class the number, gradient and curvature of the documents that the other view is sure of."""
    views, odds, out = (text, meta), (target.text.odds(text), target.meta.odds(meta)), []
    for v, model in enumerate((target.text, target.meta)):
        for label in (0.0, 1.0):
            sure = odds[1 - v] > SURE if label else odds[1 - v] < -SURE
            x = views[v][sure]
            gradient, curve = model.slopes(x, np.full(len(x), label), np.ones(len(x)))
            out += [np.array([float(len(x))]), gradient, curve.ravel()]
    return out


def _exchange(batches: Iterator, shared, sizes) -> np.ndarray:
    """The sums of ``_handed`` over this task's documents, one target after the other."""
    from corelode.llm.common import byte_texts

    total = np.zeros(sizes)
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            texts = byte_texts(part.column(0))
            basics, words = np.array([text_basics(t) for t in texts]).reshape(len(texts), 11), [_words(t) for t in texts]
            metas = [list(m.values()) for m in part.column(1).to_pylist()]
            meta = np.array([meta_basics(m) for m in metas])
            total += np.concatenate([c for t in shared.value if t for c in _handed(t, t.inputs(basics, words), meta)])
    return total


def _split(sums: np.ndarray, widths: list[int]):
    """The parts of the summed vector: (number, gradient, curvature) of both classes for each view's width."""
    at = 0
    for d in widths:
        own = []
        for _ in (0, 1):
            own.append((sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
            at += 1 + d + d * d
        yield own


def exchange(rows: DataFrame, targets: list, own: tuple, ys: list[np.ndarray]) -> None:
    """One round over all ``rows`` (t, m): each view of each target takes a step."""
    live = [t for t in targets if t]
    widths = [len(m.weights) + 1 for t in live for m in (t.text, t.meta)]
    size = sum(2 * (1 + d + d * d) for d in widths)
    shared = rows.sparkSession.sparkContext.broadcast(targets)
    parts = iter(list(_split(gathered(rows, lambda it: _exchange(it, shared, size), size), widths)))
    basics, words, meta = own
    for target, y in zip(targets, ys, strict=True):
        if not target:
            continue
        fitted, moved = ~_aside(len(y)), []
        for model, x in ((target.text, target.inputs(basics, words)), (target.meta, meta)):
            gradient, curve = model.slopes(x[fitted], y[fitted], _shares(y[fitted]))
            for many, g, c in next(parts):
                # Few pseudo-labels weigh less than as many labelled documents would.
                weight = HANDED_WEIGHT / max(many, fitted.sum())
                gradient, curve = gradient + weight * g, curve + weight * c
            moved.append(model.moved(gradient, curve))
        target.text, target.meta = moved


def calibrate(target: Target, basics, words, meta, y) -> None:
    aside = _aside(len(y))
    held = [target.text.odds(target.inputs(basics, words)[aside]), target.meta.odds(meta[aside])]
    fits = [logistic(o[:, None], y[aside], ridge=1e-3) for o in held]
    target.calibrated = tuple((float(f.weights[0] / f.scale[0]), float(f.bias - f.weights[0] * f.mean[0] / f.scale[0])) for f in fits)
    both = np.c_[tuple(a * o + b for (a, b), o in zip(target.calibrated, held, strict=True))]
    target.combined = logistic(both, y[aside], ridge=1e-3)


@dataclass
class Scorer:
    """Quality and toxicity; a target that could not be learned is None (all pass)."""

    quality: Target | None
    toxic: Target | None

    def score(self, texts: list[bytes], meta_rows: list[list]) -> dict[str, np.ndarray]:
        basics, words = np.array([text_basics(t) for t in texts]), [_words(t) for t in texts]
        meta = np.array([meta_basics(m) for m in meta_rows])
        one, none = np.ones(len(texts)), np.zeros(len(texts))
        text, page, quality = self.quality.scores(basics, words, meta) if self.quality else (one, one, one)
        toxic = self.toxic.scores(basics, words, meta)[2] if self.toxic else none
        return {"text_score": text, "page_score": page, "score": quality, "toxic_score": toxic}


def _view_rows(docs: DataFrame, text_col: str, meta_cols, *more) -> DataFrame:
    metas = F.struct(*[F.col(c).alias(f"m{k}") for k, c in enumerate(meta_cols)]).alias("m")
    return docs.select(F.col(text_col).alias("t"), metas, *more)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", meta_cols=("source", "lang", "n_chars"), per_class=LABELLED_PER_CLASS, rounds: int = ROUNDS) -> Scorer:
    """Start from a bounded sample of labelled texts, by smallest hash of the id, and exchange pseudo-labels over all ``docs``.

    Ids with labels that contradict each other are not learned from.
    """
    ship(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("double"), F.col("toxic").cast("double")).where("id is not null and quality is not null and toxic is not null")
    alike = (F.min("quality") == F.max("quality")) & (F.min("toxic") == F.max("toxic"))
    marks = marks.groupBy("id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"), alike.alias("alike")).where("alike").drop("alike")
    rows = _view_rows(docs, text_col, meta_cols, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    rows = rows.where(F.col("t").isNotNull())
    both = rows.select("id", "h").join(marks, "id").withColumn("chance", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    # Only rows whose hash can be among the smallest are ranked, without their texts.
    sizes = both.groupBy(F.col("quality").alias("q"), F.col("toxic").alias("x")).agg(F.count("*").alias("n"))
    near = both.join(sizes, (F.col("quality") == F.col("q")) & (F.col("toxic") == F.col("x"))).where(F.col("chance") <= (2 * per_class + 100) * float(1 << 30) / F.col("n"))
    turn = Window.partitionBy("quality", "toxic").orderBy("chance", "id", "h")
    taken = near.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_class).select("id", "h", "quality", "toxic").distinct()
    known = rows.join(taken, ["id", "h"]).select("t", "m", "quality", "toxic").distinct().orderBy("t", "quality", "toxic", "m").collect()  # per_class for each pair
    if not known:
        return Scorer(None, None)
    raw = [r[0].encode() for r in known]
    own = (
        np.array([text_basics(t) for t in raw]), [_words(t) for t in raw],
        np.array([meta_basics(list(r[1])) for r in known]).reshape(len(known), META_BUCKETS * len(meta_cols)),
    )
    ys = [np.array([float(r[k] > 0.5) for r in known]) for k in (2, 3)]
    targets = [begin(*own, y, rare) if min(y.sum(), len(y) - y.sum()) >= 8 else None for y, rare in zip(ys, (0.0, 1.0), strict=True)]
    if any(targets):
        for _ in range(rounds):
            exchange(_view_rows(docs, text_col, meta_cols), targets, own, ys)
    for target, y in zip(targets, ys, strict=True):
        if target:
            calibrate(target, *own, y)
    return Scorer(*targets)


def _score(batches: Iterator, model, inside: str | None) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    from corelode.llm.common import byte_texts

    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            metas = [list(m.values()) for m in part.column(1).to_pylist()]
            found = model.value.score(byte_texts(pc.struct_field(part.column(0), inside) if inside else part.column(2)), metas)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.float64()) for v in found.values())], names=["id", *found])


def score(docs: DataFrame, model: Scorer, id_col="doc_id", text_col="text", meta_cols=("source", "lang", "n_chars"), inside: bool = False) -> DataFrame:
    """(id, text_score, page_score, score, toxic_score, kept) per input row; with ``inside`` the text is a field of the id, a struct, and is sent once.

    A null text is scored as an empty one; null metadata has its own bucket.  A document is kept if its
    quality score is at least 0.5 and its toxicity below 0.5; a target without 8 labelled examples of
    either class is not judged (scores 1 and 0).  Repeated rows give repeated results.  No shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand floats
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*[F.col(c).alias(f"m{k}") for k, c in enumerate(meta_cols)]).alias("m"), *([] if inside else [F.col(text_col).alias("t")]))
    found = rows.mapInArrow(lambda it: trimmed(_score(it, shared, text_col if inside else None)), f"id {kind}, text_score double, page_score double, score double, toxic_score double")
    return found.withColumn("kept", (F.col("score") >= 0.5) & (F.col("toxic_score") < 0.5)).withColumnRenamed("id", id_col)
