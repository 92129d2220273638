"""Benchmark decontamination by greedy string tiling over words.

Documents and test items that share a seed, a run of ``seed`` words, are compared. Matches are extended from the shared seeds
by running Karp-Rabin hashes; the longest match whose words are free in both texts becomes a tile, again and again, until
no match of ``seed`` words is left. The covered share of an item's words decides, in any order of its passages.

The benchmark is taken in blocks of bounded size. A block's seeds go to all tasks, which read each text once per block, so
no table of pairs is shuffled and no group of equal seeds gathers anywhere. Words are compared with A-Z lower-cased and
without punctuation at their ends. An item shorter than a seed is one seed as a whole. Null or wordless items and texts
match nothing. Repeated rows are judged alike; a null id is carried through. Texts are compared whole, whatever their length. An
empty table on either side gives no row. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.sending import received, send

SEED_WORDS = 5
COVERAGE = 0.6
BLOCK_BYTES = 32 << 20      # benchmark text that goes to the tasks at once
FIELDS = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long, coverage double, text_hash long"


def _trim(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without ASCII punctuation at their ends; a word of punctuation only stays as it is."""
    mark = np.zeros(256, bool)
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    a, b = starts.copy(), ends.copy()
    open_ = np.arange(len(a))
    while len(open_):
        open_ = open_[(a[open_] < b[open_])]
        open_ = open_[mark[raw[a[open_]]]]
        a[open_] += 1
    open_ = np.arange(len(a))
    while len(open_):
        open_ = open_[(a[open_] < b[open_])]
        open_ = open_[mark[raw[b[open_] - 1]]]
        b[open_] -= 1
    bare = a >= b
    a[bare], b[bare] = starts[bare], ends[bare]
    return a, b


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of terminated texts, and the number of words before each text (len + 1)."""
    low = W.lowered(raw)
    starts, ends, firsts = W.word_spans(low, offsets)
    return W.span_hashes(low, *_trim(low, starts, ends)), firsts


def tile(text: np.ndarray, item: np.ndarray, at_text: np.ndarray, at_item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, words) from the places of shared seeds, longest first.

    Seeds on one diagonal that touch or overlap are one maximal match. Where a tile takes words of another match, what is
    left of it on either side goes back into the list if it still has ``seed`` words.
    """
    diagonal = at_text - at_item
    order = np.lexsort((at_text, diagonal))
    diagonal, place = diagonal[order], at_text[order]
    new = np.ones(len(place), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(place))) + seed - 1
    open_ = [(int(n), int(p), int(p - d)) for n, p, d in zip(length, place[begin], diagonal[begin], strict=True)]
    used_text, used_item, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    import heapq
    heap = [(-n, p, q) for n, p, q in open_]
    heapq.heapify(heap)
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = used_text[p:p + n] | used_item[q:q + n]
        if not taken.any():
            # Equal running hashes are checked word by word before they are marked.
            if (text[p:p + n] == item[q:q + n]).all():
                used_text[p:p + n] = used_item[q:q + n] = True
                tiles.append((p, q, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= seed:
                heapq.heappush(heap, (-(b - a), p + a, q + a))
    return tiles


class Items:
    """A block of test items with the sorted hashes of their seeds."""

    def __init__(self, keys: list[int | None], texts: list[str | None], seed: int):
        raw, offsets = W.terminated(pa.array(texts, pa.string()))
        self.keys, self.seed = keys, seed
        self.words, self.firsts = word_hashes(raw, offsets)
        hashes, item, place = [], [], []
        for size in sorted({min(seed, int(n)) for n in np.diff(self.firsts)} - {0}):
            own = np.flatnonzero(np.minimum(np.diff(self.firsts), seed) == size)
            run, _ = W.shingle_hashes(self.words, self.firsts, size)
            # shingle_hashes keeps document order; places follow from the counts.
            counts = np.maximum(np.diff(self.firsts) - size + 1, np.diff(self.firsts) > 0)
            of = np.repeat(np.arange(len(counts)), counts)
            within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = np.isin(of, own)
            hashes.append(run[keep])
            item.append(of[keep])
            place.append(within[keep])
        none = np.zeros(0, np.int64)
        hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], np.concatenate([none, *item])[order], np.concatenate([none, *place])[order]
        self.sizes = sorted({min(seed, int(n)) for n in np.diff(self.firsts)} - {0})

    def matches(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Text, item and tiles of every pair that shares a seed."""
        found = []
        for size in self.sizes:
            counts = np.maximum(np.diff(firsts) - size + 1, np.diff(firsts) > 0)
            run, of = W.shingle_hashes(words, firsts, size)
            within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            low = np.searchsorted(self.hashes, run, "left")
            hit = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == run)
            if len(hit):
                number = np.searchsorted(self.hashes, run[hit], "right") - low[hit]
                at = np.arange(int(number.sum())) + np.repeat(low[hit] - np.cumsum(number) + number, number)
                fits = np.minimum(np.diff(self.firsts)[self.item[at]], self.seed) == size
                found.append(np.stack([np.repeat(of[hit], number), self.item[at], np.repeat(within[hit], number), self.place[at]])[:, fits])
        if not found:
            return
        text, item, at_text, at_item = np.concatenate(found, axis=1)
        order = np.lexsort((item, text))
        edges = np.flatnonzero((np.diff(text[order]) != 0) | (np.diff(item[order]) != 0)) + 1
        for own in np.split(order, edges):
            if len(own):
                t, i = int(text[own[0]]), int(item[own[0]])
                item_words = self.words[self.firsts[i]:self.firsts[i + 1]]
                yield t, i, tile(words[firsts[t]:firsts[t + 1]], item_words, at_text[own], at_item[own], min(self.seed, len(item_words)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", seed: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a test item of which tiles cover at least ``coverage``: ids, words, tiles, coverage, hash of the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text_col).cast("string").alias("_text"),
                             F.octet_length(item_text_col).alias("_size")).filter("_size > 0")
    total = items.agg(F.sum("_size")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(text_col).alias("_hash"))
    found = None
    for block in range(blocks):
        # One block of bounded size at a time reaches the driver and the tasks.
        part = items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block).select("_item", "_text").toArrow()
        sent = send(spark.sparkContext, Items(part["_item"].to_pylist(), part["_text"].to_pylist(), seed))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = received(sent)
            for batch in W.slices(batches):
                raw, offsets = W.terminated(batch.column(1))
                names, texts = batch.column(0), batch.column(2)
                for low, high in W.chunks(offsets):
                    words, firsts = word_hashes(raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                    out = []
                    for t, i, tiles in own.matches(words, firsts):
                        size, covered = int(own.firsts[i + 1] - own.firsts[i]), sum(n for _, _, n in tiles)
                        if covered >= coverage * size:
                            out.append((names[low + t].as_py(), own.keys[i], size, covered, len(tiles), max(n for _, _, n in tiles), covered / size, texts[low + t].as_py()))
                    if out:
                        kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in FIELDS.split(", ")])

        pairs = rows.mapInArrow(run, FIELDS)
        found = pairs if found is None else found.unionByName(pairs)
    return found
