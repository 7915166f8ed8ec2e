"""BPE encoding and decoding by forced-boundary splitting.

Byte pairs that occur inside no vocabulary token (nor inside an added token) mark certain cuts,
provided that the pre-tokenizer, too, separates the two sides.  Two families are used, each
proven against the vocabulary when the encoder is built:

* next to an ASCII white-space byte, which no token holds;
* between a Latin letter and a punctuation mark, where no token has that pair inside.

The fragments between cuts are encoded independently, many at a time and each distinct one
once per memo, and their ids are concatenated.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments that a memo holds before it is set aside; the one set aside before it is then given up.
MEMO_ENTRIES = 300_000
#: Longer fragments are encoded alone and not remembered.
MEMO_BYTES = 48
_SPACES = b" \t\n\r\x0b\x0c"
_ASCII, _LATIN = "A-Za-z", "À-ÖØ-öø-ÿ"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class FragmentEncoder:
    """Encodes texts through their forced fragments; exact for every text."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        added = [t["content"] for t in spec.get("added_tokens", [])]
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([bool(suffix) and t.endswith(suffix) for t in self.tokens])
        self.marked = bool(self.ends.any())
        self.letters = re.compile(f"[{_ASCII}{_LATIN}]+")
        inside = np.zeros((256, 256), bool)
        alphabet = _byte_alphabet()
        for token in vocab:
            body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            raw = bytes(alphabet[c] for c in body if c in alphabet)
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a, b] = True
        for content in added:
            raw = content.encode().lower()
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a, b] = True
        self.whole_only = any(inside[:, s].any() or inside[s, :].any() for s in _SPACES)
        marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        cuts = []
        for letters in (_ASCII, _LATIN):
            sample = [c.lower().encode() for c in map(chr, range(0x41, 0x100)) if re.match(f"[{letters}]", c)]
            # "<", "=" and ">" may join a combining mark that follows them, so they open no fragment.
            opens = [m for m in marks if m not in "<=>" and not any(inside[c[-1], ord(m)] for c in sample)]
            closes = [m for m in marks if not any(inside[ord(m), c[0]] for c in sample)]
            cuts += [f"(?<=[{letters}])(?=[{re.escape(''.join(opens))}])"] if opens else []
            cuts += [f"(?<=[{re.escape(''.join(closes))}])(?=[{letters}])"] if closes else []
        self.inner = re.compile("|".join(cuts)) if cuts else None
        # The same cuts in ASCII bytes, where none of the other letters occur.
        plain = [c for c in cuts if _ASCII in c]
        self.plain = re.compile("|".join(plain).encode()) if plain else None
        self.opening = os.path.commonprefix(added)[:2].encode()
        self.lowers = bool(added) and len(self.opening) == 2 and "Lowercase" in json.dumps(spec.get("normalizer"))
        # Words of a-z alone go to the library's model at once, where no normalizer changes them and no added token can lie inside.
        steps = [n for n in [spec.get("normalizer")] if n]
        steps = [m for n in steps for m in n.get("normalizers", [n])]
        kept = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} for n in steps)
        self.direct = self.marked and kept and not any(a.isalpha() for a in added)
        self.memo: dict[bytes, bytes] = {}
        self.aside: dict[bytes, bytes] = {}
        self.memo_entries = memo_entries

    def _library_ids(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes], others: list[bytes]) -> list[bytes]:
        """Ids of each fragment, many to a library call.

        ``words`` are Latin letters only, so each is one pre-token and ends at the only token
        that bears the end-of-word mark; ``others`` are told apart by their offsets.
        """
        out: list[bytes] = []
        model = self.library.model
        for s in range(0, len(words), 2048):
            if self.direct and (text := b"".join(words[s : s + 2048])).isascii() and text.islower():
                found = [[t.id for t in model.tokenize(w.decode())] for w in words[s : s + 2048]]
                raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
                ends = [4 * n for n in accumulate(map(len, found))]
                out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                continue
            text = b" ".join(words[s : s + 2048]).decode()
            ids = np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for s in range(0, len(others), 2048):
            part = b" ".join(others[s : s + 2048]).decode().split(" ")
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            cut = np.searchsorted(at, np.cumsum([0, *(len(p) + 1 for p in part)]))
            out += [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def _parts(self, fragment: bytes) -> list[bytes]:
        if fragment.isascii():
            return self.plain.split(fragment) if self.plain else [fragment]
        return [p.encode() for p in self.inner.split(fragment.decode())] if self.inner else [fragment]

    def _whole(self, fragment: bytes) -> bool:
        """Whether it has Latin letters only."""
        return fragment.isalpha() or not fragment.isascii() and bool(self.letters.fullmatch(fragment.decode()))

    def _fill(self, missing: list[bytes]) -> None:
        """Put the ids of these fragments between white space into the memo."""
        memo, whole = self.memo, self._whole
        words = [f for f in missing if f.isalpha()] if self.marked else []
        others, joined = set(), {}
        for f in [f for f in missing if not f.isalpha()] if self.marked else missing:
            if self.marked and whole(f):
                words.append(f)
            elif len(parts := self._parts(f)) == 1:
                others.add(f)
            else:
                joined[f] = parts
                others.update([p for p in parts if p not in memo])
        if self.marked:
            known = set(words)
            words += [p for p in others if whole(p) and p not in known]
            # Words of a-z alone are learned together.
            words.sort(key=lambda w: not (w.isascii() and w.islower()))
            others = [p for p in others if not whole(p)]
        others = list(others)
        memo.update(zip([*words, *others], self._learn(words, others), strict=True))
        for f, parts in joined.items():
            memo[f] = b"".join([memo[p] for p in parts])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if self.whole_only:
            return [self._library_ids(t.decode()) for t in texts]
        out = []
        for s in range(0, len(texts), 256):
            if len(self.memo) > self.memo_entries:
                self.aside, self.memo = self.memo, {}
            # The normalizer lower-cases; doing it first for ASCII halves the distinct fragments.
            # Added tokens are matched before that, so texts that may hold one stay as they are.
            split = [(t.lower() if self.lowers and self.opening not in t else t).split() for t in texts[s : s + 256]]
            missing = set().union(*split).difference(self.memo)
            # Fragments that are still in use come back from the memo set aside.
            again = missing.intersection(self.aside)
            self.memo.update(zip(again, map(self.aside.__getitem__, again), strict=True))
            missing -= again
            long = [f for f in missing if len(f) > MEMO_BYTES]
            missing.difference_update(long)
            for f in long:
                self.memo[f] = self._library_ids(f.decode())
            self._fill(list(missing))
            out += [b"".join(map(self.memo.__getitem__, fs)) for fs in split]
            for f in long:
                del self.memo[f]
        return out

    def decode(self, ids: bytes) -> str:
        """The library's decode of these ids with special tokens kept: it has no decoder, so tokens are space-joined."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def _encode(batches: Iterator, path: str, decode: bool) -> Iterator:
    import pyarrow as pa

    from corelode.llm.common import byte_texts

    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            ids = encoder(path).encode(byte_texts(part.column(1)))
            columns = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["id", "n_tokens", "ids"]
            if decode:
                columns.append(pa.array(map(encoder(path).decode, ids), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def bpe_encode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False
) -> DataFrame:
    """One row per input row: id, n_tokens, ids (binary, little-endian unsigned 32-bit), and the decoded text if asked.

    A null text is encoded as an empty one (no ids, decoded to the empty string); repeated rows
    give repeated results; an empty table gives none; other columns are not read.  No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .mapInArrow(
            lambda it: _encode(it, tokenizer_path, decode),
            f"id {kind}, n_tokens long, ids binary" + (", decoded string" if decode else ""),
        )
        .withColumnRenamed("id", id_col)
    )
