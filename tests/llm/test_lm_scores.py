"""Scores of the language model recomputed token by token from its fitted arrays."""

import re
import zlib

import numpy as np
from xxhash import xxh64_intdigest

from corelode.llm import lm

WORD, MASK = re.compile(rb"[^\x20\x09-\x0d]+"), (1 << 64) - 1


def _mixed(h, bits):
    return (h * 0x9E3779B97F4A7C15 & MASK) >> (64 - bits)


class Plain:
    def __init__(self, model, counts):
        self.model, self.counts = model, counts
        self.bits, self.part_bits = int(np.log2(model.weights.shape[1])), int(np.log2(model.parts.shape[0]))
        self.top = {int(h): int(c) for h, c in zip(model.top, model.top_class, strict=True)}

    def hash(self, word):
        return (xxh64_intdigest(word, 42) & 0xFFFFFFFF) << 16 | zlib.crc32(word[-2:]) & 0xFFFF

    def place(self, word):
        """(class, part) of a word, or of the end."""
        if word is None:
            return 0, 0
        h = self.hash(word)
        return (self.top[h], 0) if h in self.top else (1 + lm.TOP_WORDS + (h & 0xFFFF) % lm.TAIL, (h >> 32) % lm.PARTS)

    def classes(self, before, second):
        """Chances of all classes after two words."""
        one, two = (0 if w is None else self.hash(w) | 1 for w in (before, second))
        ending = 0 if before is None else (self.hash(before) & 0xFFFF) + 1
        f = [_mixed(x & MASK, self.bits) for x in (one, one * 0xC2B2AE3D27D4EB4F + two, two + 2, ending)]
        z = self.model.bias.astype(float) + sum(self.model.weights[k][f[k]].astype(float) for k in range(4))
        e = np.exp(z - z.max())
        return e / e.sum(), one

    def parts(self, one, kind):
        under = _mixed((one * 0x165667B19E3779F9 + kind) & MASK, self.part_bits)
        room = (self.model.in_part + 0.1 * (self.model.kinds_in_part + 1))[kind]
        told = self.model.parts[under].astype(float)
        return (told + lm.PRIOR * room / room.sum()) / (told.sum() + lm.PRIOR), room

    def score(self, words):
        total, tokens = 0.0, [*words, None]
        for i, word in enumerate(tokens):
            kind, part = self.place(word)
            chance, one = self.classes(tokens[i - 1] if i else None, tokens[i - 2] if i > 1 else None)
            if kind > lm.TOP_WORDS:
                share, room = self.parts(one, kind)
                chance = chance * share[part] * (self.counts.get(word, 0) + 0.1) / room[part]
            total += np.log10(chance[kind])
        return total


def test_scores(spark, odd, monkeypatch):
    fitted, fit = {}, lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: fitted.setdefault("model", fit(*a)))
    docs = odd.where("doc_id is null or doc_id not in (5, 6)").union(spark.createDataFrame([(k, f"The cat {'sat' if k % 3 else 'ran'} on a mat {k % 7} the cat", None, None, None, None) for k in range(20, 60)], odd.schema))
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    texts = {i: WORD.findall((t or "").encode().lower()) for i, t in docs.select("doc_id", "text").collect()}
    counts = {}
    for i, words in texts.items():
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    plain = Plain(fitted["model"], counts)
    for i, words in texts.items():
        assert np.isclose(got[i].score, plain.score(words), rtol=1e-4), i
    # What may follow a history sums to one: every class, every part, every known word and one unknown a part.
    model = fitted["model"]
    for before, second in ((None, None), (b"cat", b"the"), (b"unseen", b"cat")):
        chance, one = plain.classes(before, second)
        whole = chance[: lm.TOP_WORDS + 1].sum()
        for kind in range(lm.TOP_WORDS + 1, lm.CLASSES):
            share, room = plain.parts(one, kind)
            known = [w for w in counts if plain.place(w)[0] == kind]
            mass = sum(share[plain.place(w)[1]] * (counts[w] + 0.1) / room[plain.place(w)[1]] for w in known) + (share * 0.1 / room).sum()
            assert np.isclose(mass, 1)
            whole += chance[kind] * mass
        assert np.isclose(whole, 1) and model.in_class.sum() == model.tokens


def test_expectations_of_repeated_histories(monkeypatch):
    """Histories are told apart across blocks, not in each alone, and their sums are those token by token."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(3):
        texts = [b" ".join(rng.choice([b"the", b"cat", b"sat", b"on", b"a", b"mat"], rng.integers(0, 40))) for _ in range(30)]
        row, _, _ = lm._block(list(range(30)), texts, [d % 10 == 0 for d in range(30)], f"0-{k}")
        rows.append(dict(zip(("block", "ids", "held", "many", "tokens", "hashes", "endings"), row, strict=True)))
    weights, bias = (rng.normal(size=shape).astype(np.float32) for shape in ((lm.KINDS, 1 << 10, lm.CLASSES), lm.CLASSES))
    room = np.ones((lm.CLASSES, lm.PARTS))
    model = lm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), room, room, 1, 1, 1, weights, bias, np.zeros((1 << 12, lm.PARTS), np.float32))
    want, tokens = np.zeros(weights.shape), 0
    for row in rows:
        for _, _, document, features, _, _ in lm._streams(model, row):
            for f, d in zip(features.T, document, strict=True):
                if not row["held"][d]:
                    z = np.exp(bias.astype(float) + sum(weights[k, f[k]].astype(float) for k in range(lm.KINDS)))
                    for k in range(lm.KINDS):
                        want[k, f[k]] += z / z.sum()
                    tokens += 1
    monkeypatch.setattr(lm, "_rows", iter)
    monkeypatch.setattr(lm, "SUM_BATCH", 64)
    for held in (lm.HELD, 100):
        monkeypatch.setattr(lm, "HELD", held)
        found = list(lm._histories(rows, model))
        assert sum(float(many.sum()) for _, many in found) == tokens
        assert all((np.diff(keys.astype(object)) > 0).all() for keys, _ in found) and (held == 100 or len(found) == 1)
        told = {r["slice"]: np.frombuffer(r["sums"], np.float32) for b in lm._expect(rows, type("Shared", (), {"value": model})) for r in b.to_pylist()}
        pieces = np.array_split(np.zeros(weights.size), lm.SLICES)
        got = np.concatenate([told.get(k, p) for k, p in enumerate(pieces)]).reshape(weights.shape)
        assert np.allclose(got, want, rtol=1e-4, atol=1e-6)
