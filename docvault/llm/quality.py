"""Quality rules on counts of words and lines, and bands of Zstandard ratios.

A text is rejected as repetitive where it compresses too well, as incompressible where it hardly compresses. Limits depend
on the length in bytes, because short texts give a compressor little to refer to. Chunks that cover the text are judged as
well, so that a spoiled part isn't hidden by the rest: a text fails when chunks with too large a share of its bytes do. Texts
under two chunks of 4,096 bytes are cut into smaller ones, with the limits of texts of that length; a text under two of the
smallest is one chunk by itself.

A null text is empty, has no words and fails the base rules. Every row is judged alone; repeated rows are judged alike. A text of
any length is covered whole by its chunks. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvault.llm import words as W

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50          # percent of words in repeated windows of three

# Least number of bytes, lowest and highest ratio of compressed to plain bytes.
WHOLE_BANDS = [(0, 0.0, 10.0), (256, 0.30, 0.85), (512, 0.25, 0.80), (1024, 0.22, 0.70), (2048, 0.20, 0.64), (4096, 0.18, 0.60), (16384, 0.15, 0.55)]
CHUNK_BYTES = 4096
LEAST_CHUNK = 256
CHUNK_BAND = (0.15, 0.65)
MOST_BAD_CHUNKS = 0.5       # share of the bytes
FIELDS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string")


def band(n_bytes: int) -> tuple[float, float]:
    """Limits for a text of so many bytes."""
    return next((low, high) for least, low, high in reversed(WHOLE_BANDS) if n_bytes >= least)


def _per(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return again


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of terminated texts."""
    starts, ends, firsts = W.word_spans(raw, offsets)
    n = len(offsets) - 1
    inside = ~W.tables()[0][raw]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # Lines with a word, keyed with their document.
    stops = np.flatnonzero(raw == 0x0A)
    begins = np.concatenate([[0], stops[:-1] + 1])
    filled = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops = begins[filled], stops[filled]
    line_doc = np.searchsorted(offsets, begins, "right") - 1
    lines = W.mix(W.span_hashes(raw, begins, stops) + W.mix(line_doc.astype(np.uint64)))
    again = np.bincount(line_doc[_seen_before(lines)], minlength=n)
    # Windows of three words, keyed with their document.
    hashes = W.span_hashes(raw, starts, ends)
    size = np.diff(firsts)
    word_doc = np.repeat(np.arange(n), size)
    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        at = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        three = W.mix(W.mix(W.mix(hashes[at]) + hashes[at + 1]) + hashes[at + 2] + W.mix(word_doc[at].astype(np.uint64)))
        order = np.argsort(three)
        same = three[order][1:] == three[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return {"n_words": size, "word_chars": _per(inside & ((raw & 0xC0) != 0x80), offsets), "n_symbols": _per(symbol[raw], offsets),
            "n_dup_lines": again, "n_repeat_words": np.bincount(word_doc[covered], minlength=n)}


def chunk_size(n: int) -> int:
    """Bytes of a chunk of a text of ``n`` bytes: a power of two, at least two chunks where the text is long enough."""
    return n if n < 2 * LEAST_CHUNK else min(CHUNK_BYTES, 1 << ((n // 2).bit_length() - 1))


def judge(text: memoryview, packer) -> tuple[float, int, int, str | None]:
    """Ratio of the whole text, number of chunks, chunks outside their band, and why it is rejected."""
    n = len(text)
    if n == 0:
        return 1.0, 0, 0, None
    ratio = len(packer.compress(text)) / n
    low, high = band(n)
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else None
    size = chunk_size(n)
    if size == n:
        return ratio, 1, int(reason is not None), reason
    least, most = CHUNK_BAND if size == CHUNK_BYTES else band(size)
    bad = chunks = spoiled = 0
    for at in range(0, n, size):
        # The last chunk ends with the text; it answers for the bytes that no chunk before it holds.
        begin = min(at, n - size)
        own = len(packer.compress(text[begin:begin + size])) / size
        chunks += 1
        if not least <= own <= most:
            bad += 1
            spoiled += begin + size - at
    if reason is None and spoiled > MOST_BAD_CHUNKS * n:
        reason = "chunks"
    return ratio, chunks, bad, reason


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ratios and verdict."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        packer = zstandard.ZstdCompressor(level=3, write_content_size=False)
        for batch in W.slices(batches):
            raw_all, offsets_all = W.terminated(batch.column(1))
            for low, high in W.chunks(offsets_all):
                raw, offsets = raw_all[offsets_all[low]:offsets_all[high]], offsets_all[low:high + 1] - offsets_all[low]
                found = counts(raw, offsets)
                failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
                view = memoryview(np.ascontiguousarray(raw))
                judged = [judge(view[a:b - 1], packer) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ratio, chunks, bad, reason = zip(*judged, strict=True)
                fine = np.array([r is None for r in reason])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *(pa.array(found[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                     pa.array(failed), pa.array(fine & ~failed), pa.array(ratio), pa.array(chunks, pa.int64()), pa.array(bad, pa.int64()), pa.array(reason, pa.string())],
                    [f.split()[0] for f in FIELDS.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, FIELDS)
