"""Token counts of whole texts by overlap resynchronisation.

Short texts are encoded as they are.  A huge text is cut into windows that overlap; each
window is encoded with offsets, and neighbours are spliced at a *proven* stable boundary:
a position whose left character is not a space mark and whose right one is, provided that no
vocabulary piece holds such a pair inside.  Both windows must show a token start there; where
no such position lies in the overlap, or a window disagrees, the overlap is doubled, up to the
whole text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 32_768
OVERLAP_BYTES = 256


@functools.lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def seam_pattern(path: str):
    """Regex over UTF-8 of proven boundaries of this vocabulary, or None if some piece spans one."""
    model = _model(path)
    spans = re.compile("[^▁]▁")
    if any(spans.search(p) for p in model.id_to_piece(list(range(model.get_piece_size())))):
        return None
    return re.compile(rb"(?<=[^ ])(?<!\xe2\x96\x81) ")


def _starts(model, raw: bytes) -> list[int]:
    """Byte offsets at which the tokens of this window start."""
    return [p.begin for p in model.encode(raw.decode(), return_type="proto").pieces]


def _char_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_tokens(text: str, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[int, int]:
    """(tokens, windows used) of ``text``; equal to encoding it whole."""
    model, seam = _model(path), seam_pattern(path)
    raw = text.encode()
    if len(raw) <= chunk or seam is None:
        return len(model.encode(text)), 1
    seams, at = [0], chunk
    while at < len(raw):
        reach, found = overlap, None
        while found is None and at + reach // 2 < len(raw):
            found = seam.search(raw, at, min(len(raw), at + reach))
            reach *= 2
        if found is None:
            break
        seams.append(found.start())
        at = found.start() + chunk
    seams.append(len(raw))
    total, used = 0, 0
    for lo, hi in zip(seams, seams[1:], strict=False):
        reach = overlap
        while True:
            a, b = _char_start(raw, max(0, lo - reach)), _char_start(raw, min(len(raw), hi + reach))
            starts = [s + a for s in _starts(model, raw[a:b])]
            agreed = (lo == 0 or lo in starts) and (hi == len(raw) or hi in starts)
            if agreed or (a == 0 and b == len(raw)):
                break
            reach *= 2
        total += sum(lo <= s < hi for s in starts)
        used += 1
    return total, used


def _count(batches: Iterator, path: str, chunk: int, overlap: int) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n, windows = [0] * len(texts), [1] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        for s in range(0, len(short), 256):
            part = short[s : s + 256]
            for i, ids in zip(part, _model(path).encode([texts[i] for i in part], num_threads=1), strict=True):
                n[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > chunk:
                n[i], windows[i] = count_tokens(t, path, chunk, overlap)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(windows, pa.int32())],
            names=["id", "n_bytes", "n_tokens", "n_windows"],
        )


def token_counts(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, n_windows.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an
    empty table gives none; other columns, whatever their names, are not read.  No shuffle: each
    task encodes the texts of its own split, holding one Arrow batch and one window at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("t"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = rows.mapInArrow(
        lambda it: _count(it, model_path, chunk, overlap),
        f"id {kind}, n_bytes long, n_tokens long, n_windows int",
    )
    return out.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_windows"
    )
