"""Words and rolling n-gram hashes of whole Arrow string columns, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All functions work on slices of a few megabytes of
text, whatever the batch size, so a task's memory follows the slice and the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` of about ``limit`` bytes of text each: (slice, bytes, document offsets). Null texts are empty."""
    text = pc.fill_null(batch.column(column), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not len(text):
        return
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    at = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=16)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _powers(base, 1 << max(12, int(len(values)).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time through the finalizer, long words by XXH64.

    ``which`` chooses one of two hashes that don't depend on each other.
    """
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    key = np.uint64(_BASES[which])
    out = mixed(size.astype(np.uint64) + key)
    todo = np.flatnonzero(size <= _LONG_WORD)
    at, left = starts[todo], size[todo]
    while len(todo):
        part = eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64))
        out[todo] = mixed((out[todo] ^ part) + key)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], which)
    return out


def gram_hashes(words: np.ndarray, doc: np.ndarray, n: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each position on, and whether they lie in one document. ``which`` chooses the hash."""
    count = max(0, len(words) - n + 1)
    at = np.arange(count)
    return _spans_hash(words, at, at + n, _BASES[which]), doc[:count] == doc[n - 1 : n - 1 + count]


def sequence_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's whole word sequence."""
    edge = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    digests = b"".join(xxhash.xxh3_128_digest(words[s:e]) for s, e in zip(edge, edge[1:], strict=False))
    both = np.frombuffer(digests, np.uint64).reshape(n_docs, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def winnowed(grams: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least gram of any ``window`` consecutive ones of a document (all of them where equal).

    Two texts that share a run of ``window`` grams choose the same grams in it. Documents of fewer grams choose none.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    full = valid[:n] & valid[window - 1 :]
    full &= np.cumsum(np.concatenate([[0], ~valid]))[window:] == np.cumsum(np.concatenate([[0], ~valid]))[:-window]
    least = grams[:n].copy()
    for o in range(1, window):
        np.minimum(least, grams[o : o + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for o in range(window):
        chosen[o : o + n] |= full & (grams[o : o + n] == least)
    return np.flatnonzero(chosen)
