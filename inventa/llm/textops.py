"""Vectorised byte and word helpers for the tasks of the text operators.

Texts are handled as UTF-8 bytes.  Every helper works on a *chunk*: some
documents joined by a line feed, a few MB at a time, so that the temporary
arrays of a task stay small whatever the partition holds.  One document longer
than the limit forms a chunk of its own; no text is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true in the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: a word byte of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (after lower-casing A-Z)
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: a word byte of ``[^\x20\x09-\x0D]``
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts) of consecutive texts: ``starts[i]`` is the
    offset of text ``first + i``; each text is followed by one line feed, and
    ``starts`` has one more entry than there are texts."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) + 1 <= limit):
            size += len(texts[hi]) + 1
            hi += 1
        buf = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", dtype=np.uint8)
        starts = np.zeros(hi - lo + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts[lo:hi]], out=starts[1:])
        yield lo, hi, buf, starts
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(buf: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes."""
    edge = np.diff(np.concatenate(([0], word_byte[buf].view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per (non-empty, disjoint, ordered) span."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    taken = (buf[at + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at]
    return mix(np.add.reduceat(taken, first) + size.astype(np.uint64) * _MIX2)


def doc_of(position: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the text of the chunk that holds each (ascending) offset."""
    count = np.searchsorted(position, starts)
    return np.repeat(np.arange(len(starts) - 1), np.diff(count))


def ngram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes (``len(word) - n + 1`` of them)."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out = mix(out * WORD_BASE + word[k:k + m])
    return out


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null gives empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches, rows: int = 512):
    """The same rows as smaller record batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
