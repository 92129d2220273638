"""Packing of token ids into fixed windows, in document order, with cuts chosen by dynamic programming.

Candidate cuts are ends of documents, ends of sentences and, where a sentence has to be truncated, every ``STEP`` ids inside
it. A window costs its padding, which is none at a power of two, plus the penalty of its closing cut, so a sentence is truncated only where keeping it whole
would leave more padding than that penalty. The cheapest sequence of cuts comes from a window minimum kept in a monotone
queue, so each candidate enters and leaves the queue once.

Texts are sorted by id across tasks. A task packs blocks of bounded size, so its memory doesn't grow with its range. A null
text is empty and gives the closing id only. Repeated ids are packed as separate documents; null ids come first. A text of any
length is cut into as many windows as it fills. An empty table gives no piece; only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.pieces import encoder

WINDOW = 1024
SENTENCE_PENALTY = 2        # ids of padding that a cut at the end of a sentence is worth
INSIDE_PENALTY = 20         # the same inside a sentence
STEP = 16
BLOCK_IDS = 500_000         # ids packed together
RUN_BYTES = 1 << 20         # text encoded together
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(places: list[int], penalties: list[int], window: int) -> list[int]:
    """Cuts of least padding plus penalties. ``places`` begin with 0, rise by at most ``window`` and end with the last cut.

    A sequence is padded to ``window``, but not if its length is a power of two.
    """
    # cost[j] = min over i with places[j] - places[i] <= window of cost[i] + window - (places[j] - places[i]) + penalty[j];
    # without the padding where the length is a power of two, at most one i for each power.
    value, before = [0] * len(places), [0] * len(places)   # value[i] = cost[i] + places[i]
    at = np.array(places)
    bare: list[list[int]] = [[] for _ in places]
    for power in range(window.bit_length()):
        if 1 << power < window:
            i = np.searchsorted(at, at - (1 << power))
            for j in np.flatnonzero(at[np.minimum(i, len(at) - 1)] == at - (1 << power)).tolist():
                bare[j].append(int(i[j]))
    queue = deque([0])
    for j in range(1, len(places)):
        low = places[j] - window
        while places[queue[0]] < low:
            queue.popleft()
        before[j] = queue[0]
        own = value[queue[0]] + window + penalties[j]
        for i in bare[j]:
            some = value[i] - places[i] + places[j] + penalties[j]
            if some < own:
                own, before[j] = some, i
        value[j] = own
        while queue and value[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(places) - 1
    while j > 0:
        cuts.append(places[j])
        j = before[j]
    return cuts[::-1]


def padding(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ids of padding of sequences of these lengths: none at a power of two."""
    return np.where(lengths & (lengths - 1) == 0, 0, window - lengths)


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of cuts with their penalties; no gap is longer than ``STEP``."""
    places = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    number = np.maximum((np.diff(places) - 1) // STEP, 0)      # cuts inside each gap
    inside = np.repeat(places[:-1], number) + STEP * (np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + 1)
    everything = np.concatenate([places, inside])
    penalties = np.full(len(everything), SENTENCE_PENALTY)
    penalties[len(places):] = INSIDE_PENALTY
    penalties[np.searchsorted(places, doc_ends)] = 0
    order = np.argsort(everything, kind="stable")
    return everything[order].tolist(), penalties[order].tolist()


def pack_block(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Pieces of the documents of a block: document, start, length, crc, document's ids, sequence, offset."""
    cuts = np.array(choose_cuts(*candidates(doc_ends, sentence_ends), window), np.int64)
    edges = np.union1d(np.concatenate([[0], cuts]), doc_ends)
    a, b = edges[:-1], edges[1:]
    document, sequence = np.searchsorted(doc_ends, a, "right"), np.searchsorted(cuts, a, "right")
    begins = np.concatenate([[0], doc_ends[:-1]])
    raw = ids.astype("<u4")
    crc = [zlib.crc32(raw[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return {"document": document, "start": a - begins[document], "length": b - a, "ids_crc32": np.array(crc, np.int64),
            "doc_tokens": (doc_ends - begins)[document], "sequence": sequence, "offset": a - np.concatenate([[0], cuts])[sequence],
            "sequences": len(cuts)}


_ENDS = np.isin(np.arange(256), [10, 33, 46, 63])  # line feed ! . ?


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   ids: bool = False) -> DataFrame:
    """One row per piece; ``sequence_id`` grows with document order and a sequence lies within one task."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # The text's hash parts rows that share an id, or have none; their order is free.
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text").asc()]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        names, runs, ends, sentences, held = [], [], [], [], 0

        def flush():
            nonlocal sequence, names, runs, ends, sentences, held
            if not names:
                return
            every = np.concatenate(runs)
            found = pack_block(every, np.concatenate(ends), np.concatenate(sentences), window)
            of = pa.array(names, pa.int64()).take(pa.array(found["document"]))
            out = [of, *(pa.array(found[k]) for k in ("start", "length", "ids_crc32", "doc_tokens")), pa.array(found["sequence"] + sequence), pa.array(found["offset"])]
            kinds = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                edges = np.concatenate([[0], np.cumsum(found["length"])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(every.astype(np.int32))))
                kinds.append("ids")
            sequence += found["sequences"]
            names, runs, ends, sentences, held = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays(out, kinds)

        for batch in W.slices(batches):
            keys = batch.column(0).to_pylist()
            for low, found, before, raw, starts, piece_ids in encoder(tokenizer).documents(batch.column(1), RUN_BYTES):
                n = len(before) - 1
                size = np.diff(before) + 1
                own_ends = np.cumsum(size)
                with_end = np.full(int(own_ends[-1]), end_id, np.int32)
                inner = np.ones(len(with_end), bool)
                inner[own_ends - 1] = False
                with_end[inner] = found
                # A piece that ends in a stop closes a sentence; its place moves by the closing ids of the documents before it.
                stops = np.flatnonzero(_ENDS[raw[np.append(starts[1:], len(raw)) - 1]]) if len(starts) else np.zeros(0, np.int64)
                place = piece_ids[stops + 1]
                place = place + np.searchsorted(before[1:], place, "left")
                names += keys[low:low + n]
                runs.append(with_end)
                ends.append(own_ends + held)
                sentences.append(place + held)
                held += len(with_end)
                if held >= BLOCK_IDS:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, FIELDS + (", ids array<int>" if ids else ""))
