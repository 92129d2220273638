"""Token ids in binary shards under a Re-Pair grammar.

Texts are sorted by id across tasks; each task encodes its range and writes shards of bounded size. In a shard, frequent
pairs of neighbouring symbols are replaced by new symbols, round by round, until no pair is frequent or symbols run out.
A round replaces many pairs at once: of overlapping occurrences the one of the more frequent pair is taken. Pairs never
cross documents, so a document is decoded from its own symbols. Lengths of all rules' expansions are stored.

A null text is empty and has the end id only. Null ids come first; repeated ids stay separate documents. An empty table
gives no shard. Other columns of the input are not read. A document longer than a shard has one of its own. Paths are settled by
the driver; the store has to be one that Arrow's file systems can open.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.pieces import encoder, expand
from docvault.session import materialise, qualified

# Fixed values of the format.
MAGIC = b"DVREPAIR1\n"
SYMBOLS = 1 << 16           # terminals and rules of a shard together

SHARD_IDS = 2_000_000
LEAST_COUNT = 6             # a pair must occur so often in a shard to become a rule
_SLOTS = 18


def _frequent(key: np.ndarray, room: int) -> np.ndarray:
    """Most frequent pairs first, at most ``room`` of them."""
    ordered = np.sort(key)
    edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    begin = np.concatenate([[0], edge])
    counts = np.diff(np.append(begin, len(ordered)))
    often = np.flatnonzero(counts >= LEAST_COUNT)
    if len(often) > room:
        often = often[np.argpartition(-counts[often], room - 1)[:room]]
    often = often[np.argsort(-counts[often], kind="stable")]
    return ordered[begin[often]]


def repair(symbols: np.ndarray, last: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right sides of the rules, the remaining symbols, and whether each ends a document."""
    left, right, count = [], [], terminals
    symbols, last = symbols.astype(np.uint32), last.copy()
    while len(symbols) > 1 and count < SYMBOLS:
        room = max((SYMBOLS - count) // 2, 1)   # symbols are left for pairs of new symbols
        key = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        slot = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)).astype(np.intp)
        # The pairs of a slot are at least as many as those of each key in it, so most rare pairs need not be sorted.
        slot[last[:-1]] = 1 << _SLOTS
        often = np.bincount(slot, minlength=(1 << _SLOTS) + 1) >= LEAST_COUNT
        often[-1] = False
        some = np.flatnonzero(often.take(slot))
        key, slot = key.take(some), slot.take(some)
        chosen = _frequent(key, room)
        if not len(chosen):
            break
        # Pairs that meet in a slot of the look-up table wait for the next round, the more frequent goes first.
        slots = (chosen * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)
        _, one = np.unique(slots, return_index=True)
        chosen, slots = chosen[np.sort(one)], slots[np.sort(one)]
        table, rank = np.zeros(1 << _SLOTS, np.uint32), np.empty(1 << _SLOTS, np.int32)
        table[0] = 1            # key 0 is the one that an empty slot 0 would seem to hold; key 1 has another slot
        table[slots], rank[slots] = chosen, np.arange(len(chosen))
        hit = np.flatnonzero(table.take(slot) == key)
        found, own = some.take(hit), rank.take(slot.take(hit))
        if not len(found):
            break
        near = np.diff(found) == 1
        before, after = np.full(len(found), len(chosen), np.int32), np.full(len(found), len(chosen), np.int32)
        before[1:][near], after[:-1][near] = own[:-1][near], own[1:][near]
        # In a run of one pair (aaaa) every second occurrence counts.
        place = np.arange(len(found))
        place -= np.maximum.accumulate(np.where(own != before, place, 0))
        take = (own <= before) & (own <= after) & (place % 2 == 0)
        uses = np.bincount(own[take], minlength=len(chosen))
        keep = uses >= 3
        take &= keep[own]
        if not take.any():
            break
        number = np.cumsum(keep) - 1 + count
        at = found[take]
        symbols[at] = number[own[take]]
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        symbols, last = symbols.take(stay), last.take(stay)
        left.append(chosen[keep] >> np.uint32(16))
        right.append(chosen[keep] & np.uint32(0xFFFF))
        count += int(keep.sum())
    none = np.zeros(0, np.uint32)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), symbols, last


def pack(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One shard: a JSON line that names the arrays, then the arrays. ``sizes`` counts each document's ids."""
    known = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(known[-1]) + 1, np.uint32)
    number[known] = np.arange(len(known))
    symbols = number[ids]
    if len(known) > SYMBOLS:
        raise ValueError("more kinds of ids than symbols; use smaller shards")
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    left, right, symbols, last = repair(symbols, last, len(known))
    spans = np.ones(len(known) + len(left), np.uint32)
    for low, high in _levels(left, right, len(known)):
        spans[low + len(known):high + len(known)] = spans[left[low:high]] + spans[right[low:high]]
    arrays = {"doc_ids": np.array([0 if x is None else x for x in doc_ids], "<i8"), "nulls": np.array([x is None for x in doc_ids], "u1"),
              "sizes": sizes.astype("<u4"), "symbol_ends": (np.flatnonzero(last) + 1).astype("<u4"), "terminals": known.astype("<u4"),
              "left": left.astype("<u2"), "right": right.astype("<u2"), "spans": spans[len(known):].astype("<u4"), "symbols": symbols.astype("<u2")}
    out = io.BytesIO()
    out.write(MAGIC + json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode() + b"\n")
    for v in arrays.values():
        out.write(v.tobytes())
    return out.getvalue()


def _levels(left: np.ndarray, right: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that use only symbols from before the run."""
    highest, low = np.maximum(left, right).astype(np.int64) - terminals, 0
    while low < len(left):
        later = highest[low:] >= low
        high = low + int(np.argmax(later)) if later.any() else len(left)
        if high == low:
            raise ValueError("a rule uses a later symbol")
        yield low, high
        low = high


class Shard:
    """Random access to the documents of a shard."""

    def __init__(self, raw: bytes):
        if not raw.startswith(MAGIC):
            raise ValueError("not a token shard")
        end = raw.index(b"\n", len(MAGIC)) + 1
        for name, kind, n in json.loads(raw[len(MAGIC):end]):
            if end + n * np.dtype(kind).itemsize > len(raw):
                raise ValueError("the shard is cut off")
            setattr(self, name, np.frombuffer(raw, kind, n, end))
            end += n * np.dtype(kind).itemsize
        if end != len(raw):
            raise ValueError("bytes are left over")
        t = len(self.terminals)
        # Expansions of all symbols in one array.
        self.length = np.concatenate([np.ones(t, np.int64), self.spans.astype(np.int64)])
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.zeros(int(self.length.sum()), np.int32)
        self.flat[:t] = self.terminals
        for low, high in _levels(self.left, self.right, t):
            both = np.stack([self.left[low:high], self.right[low:high]], 1).ravel()
            made = expand(self.at[both], self.length[both], self.flat)
            self.flat[self.at[t + low]:self.at[t + low] + len(made)] = made

    def __len__(self) -> int:
        return len(self.sizes)

    def key(self, k: int) -> int | None:
        return None if self.nulls[k] else int(self.doc_ids[k])

    def documents(self, low: int, high: int) -> np.ndarray:
        """Ids of documents ``low`` to ``high`` (without it), end to end."""
        a, b = int(self.symbol_ends[low - 1]) if low else 0, int(self.symbol_ends[high - 1]) if high else 0
        own = self.symbols[a:b]
        ids = expand(self.at[own], self.length[own], self.flat)
        if len(ids) != int(self.sizes[low:high].sum()):
            raise ValueError("the expansion has another length than its document")
        return ids

    def slice(self, k: int, start: int, length: int) -> np.ndarray:
        """Part of a document, from only the symbols that cover it."""
        a, b = int(self.symbol_ends[k - 1]) if k else 0, int(self.symbol_ends[k])
        own = self.symbols[a:b]
        ends = np.cumsum(self.length[own])
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
        skip = start - (int(ends[i - 1]) if i else 0)
        return expand(self.at[own[i:j]], self.length[own[i:j]], self.flat)[skip:skip + length]


def _files(folder: str):
    """File system and path of a folder with its scheme, as the driver gave it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts into shards in order of ids; returns path, documents, tokens and ``start`` (ids before the shard)."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # The text's hash parts rows that share an id, or have none; their order is free.
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text").asc()]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root)
        part, shard, done = TaskContext.get().partitionId(), 0, []
        keys, runs, sizes, held = [], [], [], 0

        def flush():
            nonlocal keys, runs, sizes, held, shard
            if keys:
                name = f"{root}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.tok"
                with files.open_output_stream(name) as out:
                    out.write(pack(keys, np.concatenate(runs), np.concatenate(sizes)))
                done.append((part, shard, name, len(keys), held))
            keys, runs, sizes, held, shard = [], [], [], 0, shard + 1

        for batch in W.slices(batches):
            names = batch.column(0).to_pylist()
            for low, ids, before, *_ in encoder(tokenizer).documents(batch.column(1)):
                size = np.diff(before) + 1
                with_end = np.full(int(size.sum()), end_id, np.int32)
                inner = np.ones(len(with_end), bool)
                inner[np.cumsum(size) - 1] = False
                with_end[inner] = ids
                keys += names[low:low + len(size)]
                runs.append(with_end)
                sizes.append(size)
                held += len(with_end)
                if held >= shard_ids:
                    flush()
        flush()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)], ["part", "shard", "path", "documents", "tokens"])

    shards = materialise(rows.mapInArrow(write, "part int, shard int, path string, documents long, tokens long"), "shards")
    # Sums within each task's shards, then over tasks: the unpartitioned window has one row per task.
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("_all")).select("part", F.coalesce(F.sum("_all").over(so_far), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(shards.join(parts, "part").select("path", "documents", "tokens", (
        F.col("_before") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("start")), "starts")


def read_tokens(spark: SparkSession, shards: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids."""
    folder = qualified(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        for batch in batches:
            for path, documents, tokens, start in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                with files.open_input_stream(path) as stream:
                    shard = Shard(stream.read())
                if len(shard) != documents or int(shard.sizes.sum()) != tokens:
                    raise ValueError(f"{path} doesn't hold what was written")
                low = 0
                while low < len(shard):
                    high = min(len(shard), low + 2048)
                    all_ids = shard.documents(low, high).astype("<u4")
                    ends = np.cumsum(shard.sizes[low:high].astype(np.int64))
                    begins = ends - shard.sizes[low:high]
                    crcs = [zlib.crc32(all_ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    out = [pa.array([shard.key(k) for k in range(low, high)], pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crcs, pa.int64())]
                    if ids:
                        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(all_ids.astype(np.int32))))
                    start += int(ends[-1])
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)
                    low = high

    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    tasks = max(1, min(shards.count(), 8 * spark.sparkContext.defaultParallelism))
    return shards.select("path", "documents", "tokens", "start").repartition(tasks, "path").mapInArrow(read, fields)
