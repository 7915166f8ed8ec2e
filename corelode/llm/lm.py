"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) x P(part | class, previous) x P(token | class, part).  The first factor
is a softmax over 64 classes with hashed features of whole words: the previous token (bigram), the two
previous ones (trigram), the one before the previous (skip), and the previous token's ending.  Frequent tokens are classes of
their own; the rest fall into classes by their ending.  Inside a class a second softmax chooses
one of 16 parts by a hashed feature of the previous token and the class; it has one active feature at a time, so its
weights have the closed form of smoothed counts, and so have those of the tokens inside a part.

The weights start from the logarithm of observed over expected counts, counted over all training documents.  Then they are
trained by distributed updates: in each round the tasks sum, over all training documents, how often each feature and class occur and how often the model expects them, and one step follows the ratio of the sums.  Sums
do not depend on how documents are dealt to tasks, but for rounding.  The hash space grows with the number of tokens.
Scoring runs in numpy batches over blocks of documents.

Documents become blocks of token numbers, written once; a block's words meet their corpus counts
through a join by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import remainder, ship, written
from corelode.llm.spans import WORD_BYTES, spans

CLASSES = 64
TOP_WORDS = 40
#: Class 0 is the end of a text, 1 to 40 the frequent words, the others endings.
TAIL = CLASSES - 1 - TOP_WORDS
PARTS = 16
KINDS = 4
BLOCK_BYTES = 12_000_000
#: Rounds of updates, each over all training documents.
ROUNDS = 2
BATCH = 2_048
#: The same where expectations are summed, and the tokens of a task whose histories are told apart at once.
SUM_BATCH = 8_192
HELD = 2_000_000
#: Tokens of a block that are held as arrays at once, if no document has more.
STREAM = 400_000
SMOOTHING = 0.1
#: Share of the log ratio that a feature starts with; pseudo-counts of a part's prior.
START, PRIOR = 0.3, 20.0
#: Slices in which sums are gathered.
SLICES = 48


def hash_bits(tokens: int) -> tuple[int, int]:
    """Bits of the hash spaces of the class features and of the part features: half a bit for each doubling of the tokens."""
    half = round(np.log2(max(tokens, 1)) / 2)
    return int(np.clip(half - 1, 10, 16)), int(np.clip(half + 2, 12, 18))


def _packed(tokens: np.ndarray) -> bytes:
    """Token numbers as four planes of bytes: the high ones are nearly all zero and compress away."""
    return np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    out = np.empty(planes.shape[1], "<u4")
    for k in range(4):
        out.view(np.uint8).reshape(-1, 4)[:, k] = planes[k]
    return out


def _block(ids, texts, held, name: str):
    """(columns of one block row, words with their training counts) of some documents."""
    from xxhash import xxh64_intdigest

    words, text_of = spans(texts, WORD_BYTES, lower=True)
    coded = words.dictionary_encode()
    flat = coded.indices.to_numpy()
    size = len(coded.dictionary)
    many = np.bincount(text_of, minlength=len(texts)).astype(np.int32)
    trained = flat[~np.asarray(held, bool)[text_of]]
    counts = np.bincount(trained, minlength=size)
    order = np.argsort(-np.bincount(flat, minlength=size), kind="stable")
    turn = np.empty(size, np.int64)
    turn[order] = np.arange(size)
    counts, flat = counts[order], turn[flat]
    # Cutting the words out of their bytes is quicker than Arrow's own list.
    listed = coded.dictionary.take(order)
    edges, data = (listed.buffers()[k] for k in (1, 2))
    edges, data = np.frombuffer(edges, np.int64, size + 1).tolist(), data.to_pybytes() if data else b""
    words = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    hashes = np.fromiter((xxh64_intdigest(w, 42) & 0xFFFFFFFF for w in words), np.uint32, len(words))
    endings = np.fromiter((zlib.crc32(w[-2:]) & 0xFFFF for w in words), np.uint16, len(words))
    row = (name, ids, held, many, _packed(flat), hashes.tobytes(), endings.tobytes())
    return row, words, counts


_BLOCKS = "block string, ids array<long>, held array<boolean>, many array<int>, tokens binary, hashes binary, endings binary, word binary, local int, n long"


def _tokenise(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    from corelode.llm.common import byte_texts

    part, k, ids, texts, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def flush():
        nonlocal k, ids, texts, held, size
        row, words, counts = _block(ids, texts, held, f"{part}-{k}")
        k, ids, texts, held, size = k + 1, [], [], [], 0
        n = len(words)
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        first = [pa.array([v], t) for v, t in zip(row, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*first, *(pa.nulls(1, t) for t in (pa.binary(), pa.int32(), pa.int64()))], names=names)
        for s in range(0, n, 50_000):
            e = min(n, s + 50_000)
            blank = [pa.nulls(e - s, t) for t in kinds[1:]]
            name = pa.array([row[0]] * (e - s), pa.string())
            cells = (pa.array(words[s:e], pa.binary()), pa.array(np.arange(s, e), pa.int32()), pa.array(counts[s:e].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([name, *blank, *cells], names=names)

    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            piece = batch.slice(s, 256)
            for i, t, h in zip(piece.column(0).to_pylist(), byte_texts(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held.append(h)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield from flush()
    if ids:
        yield from flush()


@dataclass
class Model:
    top: np.ndarray  # hashes of the frequent words, sorted
    top_class: np.ndarray
    in_part: np.ndarray  # training tokens and distinct words of each class and part
    kinds_in_part: np.ndarray
    tokens: int
    distinct: int
    ends: int
    weights: np.ndarray  # KINDS x feature buckets x CLASSES
    bias: np.ndarray
    parts: np.ndarray  # part buckets x PARTS: training counts

    @property
    def in_class(self) -> np.ndarray:
        return self.in_part.sum(axis=1)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _rows(batches: Iterator) -> Iterator[dict]:
    """The rows of Arrow batches, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield from batch.slice(k, 1).to_pylist()


def _streams(model: Model, row: dict) -> Iterator[tuple]:
    """(local word or -1 for an end, class, document, features KINDS x n, part feature, part) of all tokens of a block, some whole documents at a time."""
    many = np.asarray(row["many"], np.int64)
    words = _unpacked(row["tokens"])
    endings = np.frombuffer(row["endings"], np.uint16).astype(np.int64)
    hashes = np.frombuffer(row["hashes"], np.uint32).astype(np.uint64) << np.uint64(16) | endings.astype(np.uint64)
    kind, part = 1 + TOP_WORDS + endings % TAIL, (hashes >> np.uint64(32)).astype(np.int64) % PARTS
    if len(model.top):
        at = np.minimum(np.searchsorted(model.top, hashes), len(model.top) - 1)
        is_top = model.top[at] == hashes
        kind, part = np.where(is_top, model.top_class[at], kind), np.where(is_top, 0, part)
    # By word, the last for the end of a text.
    told = (np.r_[kind, 0], np.r_[part, 0], np.r_[hashes | np.uint64(1), np.uint64(0)], np.r_[endings + 1, 0].astype(np.uint64))
    bits, part_bits = int(np.log2(model.weights.shape[1])), int(np.log2(model.parts.shape[0]))
    upto = np.r_[0, np.cumsum(many)]
    at = 0
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + STREAM, "right")) - 1)
        yield _stream(words[upto[at] : upto[end]], many[at:end], at, told, bits, part_bits)
        at = end


def _stream(words: np.ndarray, many: np.ndarray, offset: int, told: tuple, bits: int, part_bits: int) -> tuple:
    document = np.repeat(np.arange(len(many)), many + 1)
    last = np.cumsum(many + 1) - 1
    local = np.full(len(document), -1)
    inner = np.ones(len(document), bool)
    inner[last] = False
    local[inner] = words
    classes, parts, symbols, ends = (t[local] for t in told)
    first = np.r_[0, last[:-1] + 1] if len(last) else last

    def before(values: np.ndarray, steps: int) -> np.ndarray:
        moved = np.r_[np.zeros(steps, values.dtype), values[:-steps]][: len(values)]
        for k in range(steps):
            moved[np.minimum(first + k, last)] = 0
        return moved

    one, two = before(symbols, 1), before(symbols, 2)
    with np.errstate(over="ignore"):
        both = one * np.uint64(0xC2B2AE3D27D4EB4F) + two
        under = one * np.uint64(0x165667B19E3779F9) + classes.astype(np.uint64)
    features = np.stack([_mixed(x, bits).astype(np.int32) for x in (one, both, two + np.uint64(2), before(ends, 1))])
    return local, classes, document + offset, features, _mixed(under, part_bits), parts


#: Kinds from the highest bits of a key to the lowest: those of the previous word alone come first.
KEY_KINDS = (0, 3, 1, 2)


def _keys(features: np.ndarray) -> np.ndarray:
    """The features of each token as one number; tokens of one history share it."""
    key = features[KEY_KINDS[0]].astype(np.uint64)
    for k in KEY_KINDS[1:]:
        key = key << np.uint64(16) | features[k].astype(np.uint64)
    return key


def _of_keys(keys: np.ndarray) -> np.ndarray:
    features = np.empty((KINDS, len(keys)), np.int32)
    for place, k in enumerate(KEY_KINDS):
        features[k] = keys >> np.uint64(16 * (KINDS - 1 - place)) & np.uint64(0xFFFF)
    return features


def _logits(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Class scores, the largest of each row 0."""
    z = weights[0].take(features[0], axis=0)
    z += bias
    for k in range(1, KINDS):
        z += weights[k].take(features[k], axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z


def _told(*sums: np.ndarray) -> Iterator:
    """The sums, laid end to end, in slices."""
    import pyarrow as pa

    flat = [s.ravel() for s in sums]
    starts = np.r_[0, np.cumsum([len(s) for s in flat])]
    edges = np.r_[0, np.cumsum([len(x) for x in np.array_split(np.broadcast_to(0, starts[-1]), SLICES)])]
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        piece = np.concatenate([s[max(0, low - at) : max(0, high - at)] for s, at in zip(flat, starts, strict=False)]).astype(np.float32)
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()])], names=["slice", "sums"])


def _count(batches: Iterator, shared) -> Iterator:
    """How often each feature and class, each part feature and part occur in the training documents of this task."""
    model = shared.value
    # A task's counts fit 32 bits.
    size = model.weights.shape[1] * CLASSES
    sums, parts = np.zeros(KINDS * size, np.uint32), np.zeros(model.parts.shape[0] * PARTS, np.uint32)
    for row in _rows(batches):
        held = np.asarray(row["held"], bool)
        for _, classes, document, features, under, part in _streams(model, row):
            use = ~held[document]
            for k in range(KINDS):
                sums[k * size : (k + 1) * size] += np.bincount(features[k][use] * CLASSES + classes[use], minlength=size).astype(np.uint32)
            parts += np.bincount(under[use] * PARTS + part[use], minlength=parts.size).astype(np.uint32)
    yield from _told(sums, parts)


def _histories(batches: Iterator, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, how many tokens have each) of the histories of training documents, sorted, each once in about HELD tokens, across blocks."""
    room, used = np.empty(HELD, np.uint64), 0

    def flush(keys: np.ndarray):
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.diff(starts, append=len(keys)).astype(np.float32)

    for row in _rows(batches):
        held = np.asarray(row["held"], bool)
        for _, _, document, features, _, _ in _streams(model, row):
            keys = _keys(features[:, ~held[document]])
            for s in range(0, len(keys), HELD):
                piece = keys[s : s + HELD]
                if used + len(piece) > HELD:
                    yield flush(room[:used])
                    used = 0
                room[used : used + len(piece)] = piece
                used += len(piece)
    if used:
        yield flush(room[:used])


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``into[at] += rows`` where places repeat.  Rows of one place are first added in pairs, so ``rows`` is used up."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    while True:
        new = np.r_[True, at[1:] != at[:-1]]
        starts = np.flatnonzero(new)
        if len(starts) == len(at):
            break
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        odd = np.flatnonzero(rank & 1)
        rows[order[odd - 1]] += rows.take(order[odd], axis=0)
        even = rank & 1 == 0
        at, order = at[even], order[even]
    into[at] += rows.take(order, axis=0)


def _expect(batches: Iterator, shared) -> Iterator:
    """Expected counts of each feature and class over this task's training documents."""
    model = shared.value
    told = np.zeros(model.weights.shape)
    ones = np.ones(CLASSES, np.float32)
    for keys, many in _histories(batches, model):
        for s in range(0, len(keys), SUM_BATCH):
            f = _of_keys(keys[s : s + SUM_BATCH])
            # The first and the last kind come of the previous word and lie in order: what they add is worked out once a run.
            runs = np.flatnonzero(np.r_[True, (f[0, 1:] != f[0, :-1]) | (f[3, 1:] != f[3, :-1])])
            first, last = f[0, runs], f[3, runs]
            of_run = model.weights[0].take(first, axis=0)
            of_run += model.weights[3].take(last, axis=0)
            of_run += model.bias
            chance = np.repeat(of_run, np.diff(runs, append=f.shape[1]), axis=0)
            chance += model.weights[1].take(f[1], axis=0)
            chance += model.weights[2].take(f[2], axis=0)
            chance -= chance.max(axis=1, keepdims=True)
            np.exp(chance, out=chance)
            chance *= (many[s : s + SUM_BATCH] / (chance @ ones))[:, None]
            by_run = np.add.reduceat(chance, runs, axis=0)
            _add_rows(told[0], first, by_run.copy())
            _add_rows(told[3], last, by_run)
            _add_rows(told[1], f[1], chance.copy())
            _add_rows(told[2], f[2], chance)
    yield from _told(told)


def _summed(key, table):
    import pyarrow as pa

    total = sum(np.frombuffer(v, np.float32).astype(np.float64) for v in table.column("sums").to_pylist())
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()])})


def _gathered(blocks: DataFrame, task, size: int) -> np.ndarray:
    """The sums of ``task`` over all blocks, slice by slice; their size is that of the hash spaces.

    Each task tells one set of sums, so blocks are put together into as many tasks as run at once: what is shuffled does not grow with the corpus.
    """
    blocks = blocks.coalesce(max(1, blocks.sparkSession.sparkContext.defaultParallelism))
    rows = blocks.mapInArrow(task, "slice int, sums binary").groupBy("slice").applyInArrow(_summed, "slice int, sums binary").collect()
    pieces = np.array_split(np.zeros(size), SLICES)
    for r in rows:
        pieces[r[0]] = np.frombuffer(r[1])
    return np.concatenate(pieces)


def _score(key, blocks, counts, shared):
    import pyarrow as pa

    model = shared.value
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    found: list[list] = [[] for _ in names]
    for row in blocks.to_pylist():
        by_word = np.zeros(len(row["hashes"]) // 4 + 1, np.int64)
        by_word[counts.column("local").to_numpy()] = counts.column("c").to_numpy()
        by_word[-1] = model.ends
        n = len(row["many"])
        known, told = np.zeros(n, np.int64), np.zeros((2, n))
        room = model.in_part + SMOOTHING * (model.kinds_in_part + 1)
        even = room / room.sum(axis=1, keepdims=True)
        for local, classes, document, features, under, part in _streams(model, row):
            seen = by_word[local]
            base = np.log10((seen + SMOOTHING) / (model.tokens + SMOOTHING * (model.distinct + 1)))
            of_part = (model.parts[under, part] + PRIOR * even[classes, part]) / (model.parts.sum(axis=1)[under] + PRIOR)
            score = np.where(classes <= TOP_WORDS, 0.0, np.log10(of_part * (seen + SMOOTHING) / room[classes, part]))
            keys = _keys(features)
            order = np.argsort(keys)
            ranked = keys[order]
            first = np.r_[True, ranked[1:] != ranked[:-1]]
            starts, turn = np.flatnonzero(first), np.cumsum(first) - 1
            histories = _of_keys(ranked[starts])
            ends = np.append(starts, len(keys))
            for s in range(0, len(starts), BATCH):
                e = min(len(starts), s + BATCH)
                logs = _logits(model.weights, model.bias, histories[:, s:e])
                total = np.log(np.exp(logs).sum(axis=1))
                part_of = slice(ends[s], ends[e])
                at, row_of = order[part_of], turn[part_of] - s
                score[at] += (logs[row_of, classes[at]] - total[row_of]) / np.log(10)
            known += np.bincount(document, seen > 0, n).astype(np.int64)
            told += [np.bincount(document, base, n), np.bincount(document, score, n)]
        columns = (row["ids"], row["held"], np.asarray(row["many"], np.int64) + 1, known, np.full(n, model.tokens), *told)
        for into, values in zip(found, columns, strict=True):
            into += list(values)
    return pa.table([pa.array(v, t) for v, t in zip(found, kinds, strict=True)], names=names)


def fit(blocks: DataFrame, firsts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of the written blocks; ``firsts`` has each training word with its count, hash and ending."""
    spark = blocks.sparkSession
    top = firsts.orderBy(F.desc("c"), "word").select("hash", "c", "ending", "part").limit(TOP_WORDS).collect()
    tails = firsts.groupBy(F.pmod("ending", F.lit(TAIL)).alias("k"), "part").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # at most TAIL x PARTS rows
    model = _start(top, tails, int(blocks.select(F.explode("held").alias("h")).where("not h").count()))
    # Tasks get the arrays they read: none for counts, the weights for expectations; of the hash spaces' size.
    bare = replace(model, weights=model.weights[:, :, :0], parts=model.parts[:, :0])
    shared = spark.sparkContext.broadcast(bare)
    sums = _gathered(blocks, lambda it: _count(it, shared), model.weights.size + model.parts.size)
    shared.unpersist()
    model.parts = sums[model.weights.size :].reshape(model.parts.shape).astype(np.float32)
    seen = sums[: model.weights.size].reshape(model.weights.shape)
    share = (model.in_class + SMOOTHING) / (model.in_class + SMOOTHING).sum()
    told = seen.sum(axis=2, keepdims=True) * share
    model.weights = (START * np.log((seen + 1) / (told + 1))).astype(np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(replace(bare, weights=model.weights, bias=model.bias))
        told = _gathered(blocks, lambda it, s=shared: _expect(it, s), model.weights.size).reshape(model.weights.shape)
        shared.unpersist()
        # What is observed has been counted before; each token has one feature of the first kind.
        model.weights = model.weights + (np.log((seen + 2) / (told + 2)) / 2).astype(np.float32)
        model.bias = model.bias + (np.log((seen[0].sum(axis=0) + 2) / (told[0].sum(axis=0) + 2)) / 2).astype(np.float32)
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per input row.

    Documents whose crc32(id as text) mod 10 is not 0 are learned from.  A null text is empty: one end.
    Rows with a null id are held out.  Repeated rows count as documents each; an empty table gives no
    rows.  Where nothing can be learned, every token is unknown and the classes stay even.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(remainder(id_col, 10) == 0, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), held.alias("held"))
    table = written(rows.mapInArrow(_tokenise, _BLOCKS), "lm-blocks")
    blocks = table.where("ids is not null").select("block", "ids", "held", "many", "tokens", "hashes", "endings")
    words = table.where("word is not null").select("block", "word", "local", "n")
    counted = words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    # The numbers that blocks hold for a word: 32 bits of its hash above 16 of its ending's checksum.
    ending = F.crc32(F.substring("word", -2, 2)).bitwiseAND(F.lit(0xFFFF))
    counted = counted.withColumn("ending", ending).withColumn("hash", F.shiftleft(F.xxhash64("word").bitwiseAND(F.lit(0xFFFFFFFF)), 16).bitwiseOR(F.col("ending")))
    part = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(PARTS)).cast("int").alias("part")
    counted = written(counted.select("word", "c", "hash", "ending", part), "lm-counts")
    shared = spark.sparkContext.broadcast(fit(blocks, counted, rounds))
    known = words.select("block", "word", "local").join(counted.select("word", "c"), "word").select(F.col("block").alias("in_block"), "local", "c")
    found = blocks.groupBy("block").cogroup(known.groupBy("in_block")).applyInArrow(
        lambda key, left, right: _score(key, left, right, shared),
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return found.withColumnRenamed("id", id_col)


def _start(top, tails, ends: int) -> Model:
    """The model before training: class weights from counts, all features zero."""
    in_part, kinds = np.zeros((CLASSES, PARTS)), np.zeros((CLASSES, PARTS))
    in_part[0, 0], kinds[0, 0] = ends, ends > 0
    for r in tails:
        in_part[1 + TOP_WORDS + r.k, r.part], kinds[1 + TOP_WORDS + r.k, r.part] = r.c, r.n
    for k, r in enumerate(top):
        in_part[1 + k, 0], kinds[1 + k, 0] = r.c, 1
        in_part[1 + TOP_WORDS + r.ending % TAIL, r.part] -= r.c
        kinds[1 + TOP_WORDS + r.ending % TAIL, r.part] -= 1
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    in_class, bits = in_part.sum(axis=1), hash_bits(int(in_part.sum()))
    bias = np.log((in_class + 0.1) / (in_class + 0.1).sum()).astype(np.float32)
    return Model(
        hashes[order], order.astype(np.int64) + 1, in_part, kinds, int(in_part.sum()), int(kinds.sum()), ends,
        np.zeros((KINDS, 1 << bits[0], CLASSES), np.float32), bias, np.zeros((1 << bits[1], PARTS), np.float32),
    )
