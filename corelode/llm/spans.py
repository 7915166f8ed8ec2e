"""Word spans of many UTF-8 texts at once, as numpy arrays and Arrow words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of ``[^\x20\x09-\x0D]``, and of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]`` (all bytes of other characters than ASCII are 0x80 or more).
WORD_BYTES = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
TERM_BYTES = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: Only A-Z become a-z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def chunks(texts: list[bytes], most: int) -> Iterator[slice]:
    """Slices of the list that hold about ``most`` bytes each; a longer text is alone."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if k > at and held + len(t) > most:
            yield slice(at, k)
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def spans(texts: list[bytes], kind: np.ndarray, lower: bool = False):
    """(words as an Arrow binary array, number of the text of each word) of maximal stretches of bytes of a kind."""
    import pyarrow as pa

    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = kind[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = raw[inside]
    if lower:
        data = LOWER[data]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(text_ends, starts, "right")
