"""Spelling variants: words that differ by one letter, found with blocked Gram matrices of letter counts.

Counting. Runs of Latin letters are found in the bytes of whole texts, with their checksums, and summed up in each task before
they are shuffled.

Pairs. Two words that differ by one inserted, deleted or replaced letter have lengths that differ by at most one, and letter
counts at squared distance one or two. A block holds words of lengths b and b + 1; the product of its matrix of letter counts with
itself gives all squared distances at once, and only pairs at most two apart are compared letter by letter.

Blocks stay small at every size of the vocabulary: a group begins as all words of lengths b and b + 1 whose edit may lie
anywhere. A group of more than ``BLOCK`` words is split by halves of the window in which the edit lies; words in such a half
share all letters outside it. Windows part the places, so each pair is met in one group; a word is sent on once for each half, at
most twice its length in all. A window of one place can't be split further; it has at most 8,190 words of the 90 letters. Rows of
a product are taken ``BLOCK`` at a time. No pair is capped.

Null and empty texts have no words. A null id changes no letter. Repeated rows count as often as they occur. Very long texts
and words are treated whole. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.pieces import expand
from docvault.llm.tally import Tally
from docvault.session import is_small, lookup_join, materialise

LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10                  # a form is at least so many times as frequent
STEP = 31                   # one run in so many loses a letter
BLOCK = 512                 # words of one group that are multiplied at once
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def run_checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, carried on from the checksum ``before`` it."""
    table = W.worker_cache("crc", _crc_table)
    out, sizes = np.empty(len(starts), np.uint32), ends - starts
    for k in np.flatnonzero(sizes > 64).tolist():
        out[k] = zlib.crc32(raw[starts[k]:ends[k]], int(before[k]))
    short = np.flatnonzero(sizes <= 64)
    short = short[np.argsort(-sizes[short], kind="stable")]
    at, state = starts[short], ~before[short].astype(np.uint32)
    more = len(short) - np.cumsum(np.bincount(sizes[short], minlength=1))  # spans longer than k
    for k, n in enumerate(more.tolist()):
        if not n:
            break
        part = state[:n]
        state[:n] = table[(part ^ raw[at[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[short] = ~state
    return out


def letter_runs(raw: np.ndarray, offsets: np.ndarray, ids: list, least: int = LEAST_LETTERS, step: int = STEP) -> pa.Array:
    """Runs of Latin letters of terminated texts, A-Z lower-cased, with at least ``least`` letters; where ``step`` divides the
    checksum h of ``<id>:<run>``, without letter number h modulo length."""
    low = W.lowered(raw)
    lead = low == 0xC3                                  # U+00C0 to U+00FF are C3 and one more byte
    inside = _LETTER[low] | lead
    inside[1:] |= lead[:-1]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    letters = np.concatenate([[0], np.cumsum(~lead)])   # one byte of every letter is no lead
    size = letters[ends] - letters[starts]
    starts, ends, size = (x[size >= least] for x in (starts, ends, size))
    doc = np.searchsorted(offsets, starts, "right") - 1
    keep = np.ones(len(low), bool)
    known = np.array([i is not None for i in ids], bool)
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    checks = run_checksums(low, starts, ends, before[doc]) if len(starts) else np.zeros(0, np.uint32)
    hit = (checks % np.uint32(step) == 0) & known[doc]
    if hit.any():
        # Place of the letter's last byte, which is no lead.
        place = np.flatnonzero(~lead)[letters[starts[hit]] + checks[hit] % size[hit]]
        keep[place] = False
        keep[place[lead[place - 1] & (place > 0)] - 1] = False
        fits = size - hit >= least
        starts, ends = starts[fits], ends[fits]
    kept = np.concatenate([[0], np.cumsum(keep)])
    starts, ends, low = kept[starts], kept[ends], low[keep]
    data = expand(starts, ends - starts, low)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, step: int = STEP) -> DataFrame:
    """``word`` and its number of occurrences ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(pa.schema([("word", pa.string()), ("n", pa.int64())]))
        for batch in W.slices(batches):
            ids = batch.column(0).to_pylist()
            raw, offsets = W.terminated(batch.column(1))
            for low, high in W.chunks(offsets, 4 << 20):
                own = offsets[low:high + 1] - offsets[low]
                found = letter_runs(raw[offsets[low]:offsets[high]], own, ids[low:high], least, step).value_counts()
                tally.add(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                yield from tally.full()
        yield from tally.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(rows: np.ndarray, length: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that differ by one edit at a place from ``low`` to before ``high``.

    ``rows`` are letters (0 beyond the end), ``length`` the number of letters; a group has words of lengths b and b + 1, and its pairs
    at least one of length b. All rows have the same b, the width of ``rows`` less one.
    """
    n, width = rows.shape
    base = width - 1
    alphabet = np.zeros(256, np.int64)
    used = np.unique(rows)
    used = used[used > 0]
    alphabet[used] = np.arange(len(used))
    counts = np.zeros((n, len(used)), np.float32 if width < 2048 else np.float64)
    filled = rows > 0
    np.add.at(counts, (np.nonzero(filled)[0], alphabet[rows[filled]]), 1)
    square, short = (counts * counts).sum(axis=1), np.flatnonzero(length == base)
    found = []
    for begin in range(0, len(short), BLOCK):
        tile = short[begin:begin + BLOCK]
        distance = square[tile, None] + square[None, :] - 2 * (counts[tile] @ counts.T)
        one, two = np.nonzero((distance <= 2.5) & (distance > 0.5))
        one = tile[one]
        # Each pair once, the shorter word first.
        keep = (group[one] == group[two]) & ((length[two] > base) | (one < two))
        found.append((one[keep], two[keep]))
    first, second = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = np.ones(len(first), bool)
    for begin in range(0, len(first), max(1, (4 << 20) // width)):  # letters of bounded size at once
        part = slice(begin, begin + max(1, (4 << 20) // width))
        x, y = rows[first[part]], rows[second[part]]
        unlike = x != y
        head = unlike.argmax(axis=1)                                 # the words differ, so there is such a place
        longer = length[second[part]] > base
        # Letters after the place agree: as they stand, or moved by one.
        moved = np.where(longer[:, None], np.concatenate([x[:, -1:], x[:, :-1]], axis=1), x) != y
        out[part] = ~(moved & (np.arange(width) > head[:, None])).any(axis=1) & (low[first[part]] <= head) & (head < high[first[part]])
    return first[out], second[out]


def _block_summary(words: pa.Array, counts: np.ndarray, base: int, group: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For each word of a block with near words: their number, the largest count among them and the first word that has it."""
    text = [w.encode("latin-1") for w in words.to_pylist()]
    length = np.fromiter(map(len, text), np.int64, len(text))
    rows = np.frombuffer(b"".join(t.ljust(base + 1, b"\0") for t in text), np.uint8).reshape(len(text), base + 1)
    a, b = near_pairs(rows, length, group, low, high)
    if not len(a):
        return None
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(text), np.int64)
    rank[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
    order = np.lexsort((rank[b], -counts[b], a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return words.take(pa.array(a[heads])), np.diff(np.append(heads, len(a))), counts[b[heads]], words.take(pa.array(b[heads]))


def _windows(word: Column, n: Column, parts: Column) -> list[Column]:
    """A word in a group: parts are the shorter length and the window of places of the edit."""
    base, low, high = parts["base"], parts["low"], parts["high"]
    after = F.greatest(base - high, F.lit(0))
    shared = F.xxhash64(F.substring(word, F.lit(1), low), F.substring(word, F.char_length(word) - after + 1, after))
    return [base.alias("base"), low.alias("low"), high.alias("high"), shared.alias("shared"), word.alias("word"), n.alias("n")]


def near_words(words: DataFrame, block: int = BLOCK, least: int = LEAST_LETTERS) -> DataFrame:
    """``word``, ``n_near``, ``best_n`` and ``best`` (near word of largest ``n``, ties the first) of words that have near words.

    ``words`` has distinct ``word`` of letters up to U+00FF, and ``n``.
    """
    keys = ["base", "low", "high", "shared"]
    size = F.char_length("word")
    parts = F.transform(F.filter(F.array(size - 1, size), lambda b: b >= least),
                        lambda b: F.struct(b.alias("base"), F.lit(0).alias("low"), (b + 1).alias("high")))
    open_ = words.select("word", "n", F.explode(parts).alias("p")).select(*_windows(F.col("word"), F.col("n"), F.col("p")))
    closed = []
    while True:
        open_ = materialise(open_, "windows")
        large = open_.groupBy(keys).agg(F.count(F.lit(1)).alias("_c")).filter((F.col("_c") > block) & (F.col("high") - F.col("low") > 1)).select(keys)
        large = materialise(large, "large")
        if large.isEmpty():
            closed.append(open_)
            break
        fits = is_small(large)
        salt = F.xxhash64("word")
        closed.append(lookup_join(open_, large, keys, "left_anti", salt=salt, fits=fits))
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("base", "low", middle.alias("high")), F.struct("base", middle.alias("low"), "high"))
        open_ = lookup_join(open_, large, keys, salt=salt, fits=fits).select("word", "n", F.explode(halves).alias("p"))
        open_ = open_.select(*_windows(F.col("word"), F.col("n"), F.col("p")))
    groups = closed[0]
    for more in closed[1:]:
        groups = groups.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

        def blocks(table: pa.Table, ended: bool):
            """Whole groups in blocks of one base; the last group may go on in the next batch."""
            base, low, high, shared = (table.column(k).to_numpy() for k in range(4))
            new = np.ones(len(base), bool)
            new[1:] = (base[1:] != base[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (shared[1:] != shared[:-1])
            begins = np.append(np.flatnonzero(new), len(base))
            if not ended:
                begins = begins[:-1]
            group = np.cumsum(new)
            k = 0
            while k < len(begins) - 1:
                most = begins[k] + max(block, 1)
                last = max(k + 1, int(np.searchsorted(begins, most, "right")) - 1)
                last = min(last, k + int(np.searchsorted(base[begins[k:-1]], base[begins[k]], "right")))
                a, b = int(begins[k]), int(begins[last])
                k = last
                if b - a > last - k:  # else every group is a single word
                    found = _block_summary(table.column(4).slice(a, b - a).combine_chunks(), table.column(5).slice(a, b - a).to_numpy(),
                                           int(base[a]), group[a:b], low[a:b], high[a:b])
                    if found is not None:
                        yield pa.RecordBatch.from_arrays([found[0], pa.array(found[1]), pa.array(found[2]), found[3]], schema=schema)
            return int(begins[-1])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            done = yield from blocks(table, False)
            held = table.slice(done)
        if held is not None and len(held):
            yield from blocks(held, True)

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = groups.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.struct((-F.col("best_n")).alias("m"), "best")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")))


def follow(forms: DataFrame) -> DataFrame:
    """``word``, ``form`` and ``root``: where the forms lead at last. Each round doubles the distance."""
    state = materialise(forms.select("word", "form", F.col("form").alias("root"), F.lit(True).alias("_open")), "forms")
    while not state.filter("_open").isEmpty():
        # What a word points to, pointing on; a root that many words share is met by a broadcast or by salted keys.
        ahead = materialise(state.select(F.col("word").alias("root"), F.col("root").alias("_next")), "ahead")
        state = lookup_join(state.drop("_open"), ahead, ["root"], "left", salt=F.xxhash64("word"), fits=is_small(ahead))
        state = materialise(state.select("word", "form", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_open")), "forms")
    return state.drop("_open")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of enough letters and occurrences."""
    words = materialise(count_words(docs, id_col, text_col).filter(F.col("n") >= LEAST_COUNT), "words")
    near = materialise(near_words(words), "near")
    both = materialise(words.join(near, "word", "left"), "both")  # one row of a word on each side
    chosen = F.col("best_n") >= times * F.col("n")
    roots = follow(both.filter(chosen).select("word", F.col("best").alias("form")))
    return both.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))
