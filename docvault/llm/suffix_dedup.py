"""Removal of byte strings that a document with a smaller id holds as well, found with suffix arrays.

No byte string is compared with all others. Each window of ``length`` bytes is filed under the smallest hash of the
``GRAM``-byte grams in it; equal windows have equal keys wherever they stand. Neighbouring windows with one key make a span.
Only spans whose key occurs in several documents go on:

1. Later copies of whole texts are settled by their digest. The other texts are packed into blocks in the tasks that read
   them; the blocks are a bucketed table, so later joins by block do not move text.
2. A block sends its keys, four bytes each, to buckets; a bucket answers with one bit per key: shared or not.
3. A block sends each distinct shared span once, for its smallest document, to buckets by key. A bucket sorts the suffixes
   of its spans (two-stage suffix array), takes common prefixes of neighbours, and answers which windows occur in a smaller
   document. A key with very many spans is replaced by the hashes of its single windows, so no key fills a bucket.
4. A block joins the answers to runs of bytes and removes them.

A null text is empty; texts shorter than ``length`` lose nothing. Rows of equal id never remove each other's bytes; a null id
counts as the largest. Strings are judged on the input, overlaps count, and matches never cross documents. An empty table gives an
empty result. Only the named columns are read; a carried column may not have the name of a result. Texts are whole, whatever their
length: a block holds at least one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvault.llm import words as W
from docvault.llm.suffix_array import PAD, common_prefixes, suffix_array
from docvault.session import fresh_path, is_small, lookup_join, materialise

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 1 << 20
KEYED_BYTES = 32 << 20      # text whose keys share a bucket
BUCKET_BYTES = 2 << 20      # shared spans per bucket; a task holds some dozen times as much while it sorts them
RUN_BYTES = 67              # mean length of a span: 35 grams to a window, a new least one after every 17 or so
HOT_SPANS = 100_000         # beyond so many spans a key is replaced by its windows' hashes
LAST = (1 << 63) - 1        # a null id
WINDOW_BYTES = 256 << 10    # text whose windows are hashed at once
_TOP = np.iinfo(np.uint64).max


def window_runs(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: first place, number of windows, key, document."""
    width = length - GRAM + 1
    found = []
    for low, high in W.chunks(offsets, WINDOW_BYTES):
        part, own = raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        n = len(part) - GRAM + 1
        if n < width:
            continue
        sums, down = W.running(part)
        hashes = W.mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
        # Minimum over each window: the end of one block of ``width`` and the beginning of the next.
        padded = np.concatenate([hashes, np.full(-n % width + width, _TOP, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        key = np.minimum(behind[:windows], ahead[width - 1:width - 1 + windows])
        edge = np.ones(windows + 1, bool)
        edge[1:-1] = key[1:] != key[:-1]
        # A document's windows end before the next document begins.
        sizes = np.diff(own)
        stop = own[1:] - length + 1
        inside = np.zeros(windows + 1, np.int32)
        some = sizes >= length
        np.add.at(inside, own[:-1][some], 1)
        np.add.at(inside, np.minimum(stop[some], windows), -1)
        edge[own[:-1][some]] = True
        edge[np.minimum(stop[some], windows)] = True
        covered = np.cumsum(inside[:-1]) > 0
        at = np.flatnonzero(edge)
        begin, number = at[:-1], np.diff(at)
        keep = covered[begin]
        begin, number = begin[keep], number[keep]
        found.append((begin + offsets[low], number, key[begin], np.searchsorted(own, begin, "right") - 1 + low))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _span_hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans that may overlap; sorted by place."""
    out = np.zeros(len(begin), np.uint64)
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + WINDOW_BYTES)))
        a = int(begin[low])
        stop = int((begin[low:high] + size[low:high]).max())
        sums, down = W.running(raw[a:stop])
        x, y = begin[low:high] - a, begin[low:high] + size[low:high] - a
        out[low:high] = (sums[y] - sums[x]) * down[x] + size[low:high].astype(np.uint64)
        low = high
    return W.mix(out)


class Block:
    """Texts of a block with their runs of windows."""

    def __init__(self, ids: bytes, ends: bytes, text: bytes, length: int):
        import zstandard
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.concatenate([[0], np.frombuffer(ends, np.int64)])
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8) if len(text) else np.zeros(0, np.uint8)
        self.length = length
        self.begin, self.number, self.key, self.doc = window_runs(self.raw, self.offsets, length)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, whether several documents of the block have them, and their number of runs."""
        order = np.argsort(self.key, kind="stable")
        key, of = self.key[order], self.ids[self.doc[order]]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            return key, np.zeros(0, bool), np.zeros(0, np.int64)
        return key[first], np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first), np.diff(np.append(first, len(key)))

    def spans(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Distinct shared spans in the order of (hash, document): begin, size, key; ``of_run`` maps each run to its span or -1.

        A span of a later document that an earlier one of the block holds too is in ``settled``: it goes whole.
        """
        known, *_ = self.keys()
        at = np.searchsorted(known, self.key)
        pick = shared[at] if len(known) else np.zeros(0, bool)
        burning = pick & (hot[at] if len(known) else False)
        begin, number, key, doc = (x[pick & ~burning] for x in (self.begin, self.number, self.key, self.doc))
        if burning.any():
            # Single windows, keyed by their own hashes.
            b, n, d = self.begin[burning], self.number[burning], self.doc[burning]
            each = np.arange(int(n.sum())) + np.repeat(b - np.cumsum(n) + n, n)
            own = _span_hashes(self.raw, each, np.full(len(each), self.length))
            begin, number = np.concatenate([begin, each]), np.concatenate([number, np.ones(len(each), np.int64)])
            key, doc = np.concatenate([key, own]), np.concatenate([doc, np.repeat(d, n)])
            order = np.argsort(begin, kind="stable")
            begin, number, key, doc = begin[order], number[order], key[order], doc[order]
        size = number + self.length - 1
        self.s_begin, self.s_size, self.s_key, self.s_id = begin, size, key, self.ids[doc]
        hashes = _span_hashes(self.raw, begin, size)
        order = np.lexsort((self.s_id, hashes))
        sorted_hash, sorted_id = hashes[order], self.s_id[order]
        new = np.append(True, sorted_hash[1:] != sorted_hash[:-1]) if len(order) else np.zeros(0, bool)
        number_of = np.cumsum(new) - 1
        heads = order[new]
        least = sorted_id[new]
        self.of_run = np.empty(len(order), np.int64)
        self.of_run[order] = number_of
        self.settled = self.s_id > least[self.of_run] if len(order) else np.zeros(0, bool)
        self.heads, self.least = heads, least


def _gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def smaller_windows(spans: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of each span, in order, whether it occurs in a span with a smaller id."""
    begin = np.cumsum(sizes) - sizes
    hashes = _span_hashes(spans, begin, sizes)
    order = np.lexsort((ids, hashes))
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    heads, least = order[new], ids[order][new]
    # One suffix array over the distinct spans.
    text = np.concatenate([_gather(spans, begin[heads], sizes[heads]), np.zeros(PAD, np.uint8)])
    number = sizes[heads] - length + 1
    head_begin = np.cumsum(sizes[heads]) - sizes[heads]
    window_at = np.arange(int(number.sum())) + np.repeat(head_begin - np.cumsum(number) + number, number)
    wanted = np.zeros(len(text), bool)
    wanted[window_at] = True
    place = np.zeros(len(text), np.int64)
    place[window_at] = np.arange(len(window_at))
    suffixes = suffix_array(text, wanted, length)
    same = common_prefixes(text, suffixes, length) >= length
    first = np.flatnonzero(~same)
    own = np.repeat(least, number)[place[suffixes]]
    smallest = np.empty(len(window_at), np.int64)
    smallest[place[suffixes]] = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
    # Back to every span.
    counts = sizes - length + 1
    head_window = np.cumsum(number) - number
    back = np.arange(int(counts.sum())) + np.repeat(head_window[of] - np.cumsum(counts) + counts, counts)
    return smallest[back] < np.repeat(ids, counts)


def _packed_blocks(rows: DataFrame, carry: list[str]) -> DataFrame:
    """One row per block: ids, ends of texts, compressed text, carried columns as an Arrow stream."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        packer, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 33
        ids, ends, texts, kept, held, docs = [], [], [], [], 0, 0

        def flush():
            nonlocal number, ids, ends, texts, kept, held, docs
            stream = pa.BufferOutputStream()
            with pa.ipc.new_stream(stream, kept[0].schema) as out:
                for part in kept:
                    out.write_batch(part)
            row = (number, np.concatenate(ids).tobytes(), np.concatenate(ends).tobytes(), packer.compress(np.concatenate(texts).tobytes()), stream.getvalue().to_pybytes())
            number, ids, ends, texts, kept, held, docs = number + 1, [], [], [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "ids", "ends", "text", "kept"])

        for batch in batches:
            raw, offsets = W.utf8(batch.column(1))
            names = batch.column(0).to_numpy()
            for low, high in W.chunks(offsets, BLOCK_BYTES):
                ids.append(names[low:high])
                ends.append(offsets[low + 1:high + 1] - offsets[low] + held)
                texts.append(raw[offsets[low]:offsets[high]])
                kept.append(pa.RecordBatch.from_arrays(batch.columns[2:], names=carry).slice(low, high - low) if carry
                            else pa.RecordBatch.from_arrays([pa.nulls(high - low)], names=["_"]))
                held, docs = held + int(offsets[high] - offsets[low]), docs + high - low
                if held >= BLOCK_BYTES or docs >= 65536:
                    yield flush()
        if ids:
            yield flush()

    return rows.mapInArrow(pack, "block long, ids binary, ends binary, text binary, kept binary")


def _one(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, Block, dict]]:
    for k in range(len(batch)):
        row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
        yield row["block"], Block(row["ids"], row["ends"], row["text"], length), row
        W.release()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (),
                   texts: bool = False) -> DataFrame:
    """Of each row: id, carried columns, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, what is left of the text.

    Where a cut falls inside a character, the rest of that character goes from the returned text as well.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([text_col] if texts else [])]
    if len({id_col, *carry, *results}) < 1 + len(carry) + len(results):
        raise ValueError(f"carried columns {[id_col, *carry]} clash with each other or with {results}")
    name = f"docvault_blocks_{uuid.uuid4().hex}"
    try:
        return _removed(docs, id_col, text_col, length, carry, texts, name)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int, carry: tuple[str, ...], texts: bool, name: str) -> DataFrame:
    """The steps; ``name`` is the table of blocks."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)]
    names = [f"_c{k}" for k in range(len(carry))]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), text.alias("_text"), *carried)
    digest = F.sha2("_text", 256)
    info = materialise(rows.select("_id", F.octet_length("_text").alias("_bytes"), digest.alias("_sha")), "digests")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = info.agg(F.sum("_bytes")).first()[0] or 0
    buckets = max(parts, -(-total // KEYED_BYTES))
    copies = info.groupBy("_sha").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    copies = materialise(copies.filter("_first < _last").select("_sha", "_first"), "copies")
    few = is_small(copies)
    marked = lookup_join(rows.withColumn("_sha", digest), copies, ["_sha"], "left", salt=F.xxhash64("_id"), fits=few)
    path = fresh_path(spark, "blocks")
    (_packed_blocks(marked.filter("_first is null or _first = _id").select("_id", "_text", *names), names)
     .write.format("parquet").option("path", path).option("compression", "none").bucketBy(parts, "block").saveAsTable(name))
    blocks = spark.table(name)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, _ in _one(batch, length):
                key, several, runs = block.keys()
                bucket, low = (key % np.uint64(buckets)).astype(np.int64), (key // np.uint64(buckets)).astype(np.uint32)
                # Sorted by bucket; within a bucket the keys stay ascending, so the answer's bits find their keys.
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
                cut = np.split(order, edges[1:]) if len(edges) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[x[0]]) for x in cut], pa.int64()), pa.array([number] * len(cut), pa.int64()), pa.array([low[x].tobytes() for x in cut], pa.binary()),
                     pa.array([np.where(several[x], -runs[x], runs[x]).clip(-32000, 32000).astype(np.int16).tobytes() for x in cut], pa.binary())],
                    ["bucket", "block", "keys", "runs"])

    def answer_keys(group: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 4 for x in group["keys"]]
        keys = np.frombuffer(b"".join(group["keys"]), np.uint32)
        runs = np.frombuffer(b"".join(group["runs"]), np.int16).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        count = np.diff(np.append(first, len(keys)))
        shared = (count > 1) | (np.minimum.reduceat(runs[order], first) < 0)
        hot = shared & (np.add.reduceat(np.abs(runs[order]), first) > HOT_SPANS)
        said = np.empty((2, len(keys)), bool)
        said[0][order], said[1][order] = np.repeat(shared, count), np.repeat(hot, count)
        stops = np.cumsum(sizes)
        there = np.cumsum(np.where(said[0], np.abs(runs), 0))
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "runs": np.diff(there[stops - 1], prepend=0), "answer": [
            np.packbits(said[:, b - n:b], axis=1).tobytes() for n, b in zip(sizes, stops, strict=True)]})

    keyed = blocks.select("block", "ids", "ends", "text").mapInArrow(send_keys, "bucket long, block long, keys binary, runs binary")
    answers = materialise(keyed.groupBy("bucket").applyInPandas(answer_keys, "block long, bucket long, runs long, answer binary"), "answers")
    # Few texts are shared in most corpora, so spans need fewer buckets than keys; no key fills a bucket.
    wide = max(parts, -(-RUN_BYTES * (answers.agg(F.sum("runs")).first()[0] or 0) // BUCKET_BYTES))
    # At most one answer per key of the block; a block's keys are bounded by its size.
    answers = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))

    def marks(block: Block, row: dict) -> tuple[np.ndarray, np.ndarray]:
        key, *_ = block.keys()
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))) if len(order) else []
        shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
        at = 0
        for n, said in zip(counts, row["answers"] or [], strict=True):
            bits = np.unpackbits(np.frombuffer(said["answer"], np.uint8).reshape(2, -1), axis=1)[:, :n].astype(bool)
            shared[order[at:at + n]], hot[order[at:at + n]] = bits
            at += n
        return shared, hot

    def send_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, row in _one(batch, length):
                block.spans(*marks(block, row))
                heads = block.heads
                bucket = (block.s_key[heads] % np.uint64(wide)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
                binary = lambda f, cut=cut: pa.array([f(own, block.heads[own]).tobytes() for own in cut], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[own[0]]) for own in cut], pa.int64()), pa.array([number] * len(cut), pa.int64()), binary(lambda own, mine: own.astype(np.uint32)),
                     binary(lambda own, mine: block.least[own]), binary(lambda own, mine: block.s_size[mine].astype(np.uint32)),
                     binary(lambda own, mine: _gather(block.raw, block.s_begin[mine], block.s_size[mine]))],
                    ["bucket", "block", "heads", "ids", "sizes", "spans"])

    def answer_spans(group: pd.DataFrame) -> pd.DataFrame:
        sizes = np.frombuffer(b"".join(group["sizes"]), np.uint32).astype(np.int64)
        ids, heads = np.frombuffer(b"".join(group["ids"]), np.int64), np.frombuffer(b"".join(group["heads"]), np.uint32)
        gone = smaller_windows(np.frombuffer(b"".join(group["spans"]), np.uint8), sizes, ids, length)
        # Runs of windows that go, cut at the spans' edges.
        counts = sizes - length + 1
        ends = np.cumsum(counts)
        before, after = np.append(False, gone[:-1]), np.append(gone[1:], False)
        edge = np.zeros(len(gone), bool)
        edge[ends - counts] = True
        last = np.zeros(len(gone), bool)
        last[ends - 1] = True
        low, high = np.flatnonzero(gone & (~before | edge)), np.flatnonzero(gone & (~after | last))
        span = np.searchsorted(ends, low, "right")
        base = (ends - counts)[span]
        # The block of each span, by the rows it came in.
        row_ends = np.cumsum([len(x) // 4 for x in group["sizes"]])
        row = np.searchsorted(row_ends, span, "right")
        cut = np.split(np.arange(len(low)), np.flatnonzero(np.diff(row)) + 1) if len(low) else []
        block = group["block"].to_numpy()
        W.release()
        return pd.DataFrame({"block": np.array([block[row[x[0]]] for x in cut], np.int64), "runs": [
            np.stack([heads[span[x]], low[x] - base[x], high[x] - base[x] + 1]).astype(np.uint32).tobytes() for x in cut]})

    with_answers = blocks.join(answers, "block", "left")
    spans = with_answers.select("block", "ids", "ends", "text", "answers").mapInArrow(
        send_spans, "bucket long, block long, heads binary, ids binary, sizes binary, spans binary")
    gone = materialise(spans.groupBy("bucket").applyInPandas(answer_spans, "block long, runs binary"), "gone")
    gone = gone.groupBy("block").agg(F.collect_list("runs").alias("gone"))

    kinds = [docs.schema[c].dataType for c in carry]
    fields = T.StructType([T.StructField("_id", T.LongType()), *[T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]]
                          + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
                          + [T.StructField("_kept", T.StringType())] * texts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block, row in _one(batch, length):
                block.spans(*marks(block, row))
                change = np.zeros(len(block.raw) + 1, np.int32)

                def cover(low, high, change=change):
                    np.add.at(change, low, 1)
                    np.add.at(change, high, -1)

                done = block.settled
                cover(block.s_begin[done], block.s_begin[done] + block.s_size[done])
                if row["gone"]:
                    head, low, high = np.concatenate([np.frombuffer(x, np.uint32).reshape(3, -1) for x in row["gone"]], axis=1).astype(np.int64)
                    # Every run of the least document that is equal to the span which was sent.
                    live = np.flatnonzero(~done)
                    live = live[np.argsort(block.of_run[live], kind="stable")]
                    a, b = np.searchsorted(block.of_run[live], head, "left"), np.searchsorted(block.of_run[live], head, "right")
                    n = b - a
                    at = block.s_begin[live[np.arange(int(n.sum())) + np.repeat(a - np.cumsum(n) + n, n)]]
                    cover(at + np.repeat(low, n), at + np.repeat(high, n) + length - 1)
                removed = np.cumsum(change[:-1], dtype=np.int32) > 0
                del change
                opens = removed.copy()
                opens[1:] &= ~removed[:-1]
                o = block.offsets
                inner = o[:-1][o[:-1] < len(removed)]
                opens[inner] = removed[inner]
                at = np.flatnonzero(removed), np.flatnonzero(opens)
                n_removed, n_spans = (np.diff(np.searchsorted(x, o)) for x in at)
                del at, opens
                hashes, left = [], []
                for k in range(len(block.ids)):
                    own = block.raw[o[k]:o[k + 1]]
                    if n_removed[k]:
                        own = own[~removed[o[k]:o[k + 1]]]
                    hashes.append(hashlib.sha256(own.tobytes()).hexdigest())
                    if texts:
                        left.append(own.tobytes().decode("utf-8", "ignore"))
                kept = pa.Table.from_batches(list(pa.ipc.open_stream(row["kept"]))).combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns] if carry else []
                out = [pa.array(block.ids), *columns, pa.array(np.diff(o)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(left, pa.string())] * texts, fields.fieldNames())

    found = blocks.join(answers, "block", "left").join(gone, "block", "left").mapInArrow(finish, fields)
    # Later copies of whole texts lose everything, if they are long enough to hold a string at all.
    late = lookup_join(rows.withColumn("_sha", digest), copies, ["_sha"], salt=F.xxhash64("_id"), fits=few).filter("_first < _id")
    bytes_ = F.octet_length("_text").cast("long")
    whole = bytes_ >= length
    late = late.select("_id", *names, bytes_.alias("n_bytes"), F.when(whole, bytes_).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
                       F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("_sha")).alias("kept_sha256"), *[F.when(whole, "").otherwise(F.col("_text")).alias("_kept")] * texts)
    found = materialise(found.unionByName(late), "repeats")
    return found.select(F.when(F.col("_id") != LAST, F.col("_id")).alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)],
                        "n_bytes", "n_removed", "n_spans", "kept_sha256", *[F.col("_kept").alias(text_col)] * texts)
