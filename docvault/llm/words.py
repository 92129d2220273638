"""Texts of an Arrow column as one byte array: words, pieces and their 64-bit hashes without a loop per row."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Separators of words: [\x20\x09-\x0D].
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 20


def worker_cache(name: str, make: Callable):
    """One object per Python worker; functions travel by value, so their own globals last one task only."""
    store = sys.modules.setdefault("_docvault_worker", types.ModuleType("_docvault_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def release() -> None:
    """Give freed memory back to the system, where the C library can; else a worker keeps the most it ever used."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = worker_cache("trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows, so that copies of texts stay small; freed memory goes back after each batch."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)
        release()


def _tables():
    draw = np.random.default_rng(20261)
    separator = np.zeros(256, bool)
    separator[list(SEPARATORS)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    values = draw.integers(1, 1 << 63, 256, dtype=np.uint64)
    return separator, lower, values


def tables():
    return worker_cache("tables", _tables)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and len + 1 offsets; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes; a longer document is a run by itself."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; no other character changes."""
    return tables()[1][raw]


def terminated(column) -> tuple[np.ndarray, np.ndarray]:
    """As ``utf8``, with a line feed after each text, so that no word reaches into the next text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pc.fill_null(column.cast(pa.large_string()), "")
    return utf8(pc.binary_join_element_wise(text, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of terminated texts, and for each text the number of words before it (len + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~tables()[0][raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = worker_cache("powers", lambda: [np.ones(0, np.uint64)] * 2)
    if len(have[0]) <= n:
        base, size = 0x9E3779B97F4A7C15, max(n + 1, CHUNK_BYTES // 2)
        for k, step in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(size + size // 4, step, np.uint64)
            steps[0] = 1
            have[k] = np.cumprod(steps)
    return have[0], have[1]


def running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums s and factors f: bytes from a to b hash to (s[b] - s[a]) * f[a], wherever they stand."""
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(tables()[2][raw] * up[:len(raw)], out=sums[1:])
    return sums, down


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the bytes of each span (sorted, disjoint); equal bytes give equal hashes everywhere."""
    out = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        at = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, at + CHUNK_BYTES, "right")))
        sums, down = running(raw[at:int(ends[high - 1])])
        a, b = starts[low:high] - at, ends[low:high] - at
        out[low:high] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        low = high
    return mix(out)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a document, and the document's number.

    A document with fewer words, but at least one, gives the hash of its whole sequence.
    """
    counts = np.diff(firsts)
    n = len(words)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    left = np.repeat(firsts[1:], counts) - np.arange(n)  # words from here to the document's end
    for k in range(size):
        step = np.zeros(n, np.uint64)
        if k < n:
            step[:n - k] = words[k:]
        step[left <= k] = 0
        rolled = mix(rolled * np.uint64(3) + step + np.uint64(k + 1))
    keep = (left >= size) | ((np.repeat(counts, counts) < size) & (left == np.repeat(counts, counts)))
    return rolled[keep], doc_of[keep]
