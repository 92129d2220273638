"""Near-duplicates by HyperMinHash: compressed registers, bands, a corrected estimate, then a check on full shingle sets.

A document's shingles fall into buckets; a bucket's register keeps the leading-zero count and some mantissa bits of its
smallest hash, 16 bits in all. Empty buckets borrow from filled ones in an order fixed for all documents. Documents that
share a band of registers are candidates; candidates whose estimate, corrected for chance collisions and with a margin of
several deviations, could reach the threshold are checked on their full sets.

Documents of equal sets are one class and only classes are compared. A band's group is compared inside a task, large groups
in pairs of bounded blocks. A pair is looked at in the first band it shares, and checked on full sets only while its two
classes aren't joined by other links of the group. A group sends on members and links that join them, never its pairs. No
candidate is capped or dropped.

A document without words has no shingles and is linked with nothing. Rows with equal ids are separate documents that share
a name; a null id names a component only where no row of it has an id. Null texts are empty. Only the named columns
are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.components import components
from docvault.session import is_small, lookup_join, materialise

BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
DEVIATIONS = 6.0
BLOCK_CLASSES = 1024        # classes of one group that are compared at once
PAIRS = 1 << 15             # pairs whose registers are compared at once


def distinct_shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each terminated text, end to end, and their number before each text (len + 1)."""
    low = W.lowered(raw)
    starts, ends, firsts = W.word_spans(low, offsets)
    hashes, doc = W.shingle_hashes(W.span_hashes(low, starts, ends), firsts, size)
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(offsets) <= 1 << 16 else np.int64), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(offsets)))


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Number of bits of 64-bit numbers, 0 for 0."""
    high = x >> np.uint64(32)
    upper = np.frexp(high.astype(np.float64))[1]
    lower = np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, upper + 32, lower)


def _borrow_orders() -> np.ndarray:
    return np.random.default_rng(77).integers(0, REGISTERS, (600, REGISTERS))


def registers(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """16-bit registers of each document, a row of ``REGISTERS``; zeros for a document without shingles."""
    n = len(firsts) - 1
    doc = np.repeat(np.arange(n), np.diff(firsts))
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * REGISTERS + bucket.astype(np.int64), W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    least = least.reshape(n, REGISTERS)
    bits = _bit_length(least)
    zeros = np.minimum(64 - bits, 62)
    # Mantissa: the bits after the leading one.
    shifted = least << np.minimum(65 - bits, 63).astype(np.uint64)
    code = (zeros.astype(np.uint32) << np.uint32(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA)).astype(np.uint32)
    code = code.astype(np.uint16)
    empty = least == np.iinfo(np.uint64).max
    row, column = np.nonzero(empty & (np.diff(firsts) > 0)[:, None])
    orders = W.worker_cache("borrow", _borrow_orders)
    filled, original = ~empty, code.copy()
    for attempt in range(len(orders) + REGISTERS):
        if not len(row):
            break
        # After the drawn orders, in which a filled bucket is all but certain to occur, all buckets in turn.
        donor = orders[attempt][column] if attempt < len(orders) else (column + attempt) % REGISTERS
        found = filled[row, donor]
        code[row[found], column[found]] = original[row[found], donor[found]]
        row, column = row[~found], column[~found]
    code[np.diff(firsts) == 0] = 0
    return code


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that two registers of unrelated sets of these sizes agree."""
    total = np.zeros(len(n))
    a, b = (np.maximum(x / REGISTERS, 1.0) for x in (n, m))
    for z in range(40):
        p, q = (((1 - 2.0 ** -(z + 1)) ** x - (1 - 2.0 ** -z) ** x) for x in (a, b))
        total += p * q
    return total / 2 ** MANTISSA


def could_link(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the corrected estimate leaves a similarity of ``percent`` possible. Registers are rows of ``REGISTERS``."""
    c = chance(n, m)
    estimate = ((left == right).mean(axis=1) - c) / (1 - c)
    least = percent / 100
    spread = np.sqrt(least * (1 - least) / np.minimum(REGISTERS, np.maximum(np.minimum(n, m) / 2, 1)))
    return (estimate >= least - DEVIATIONS * spread) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _fixed(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _known(key: Column) -> Column:
    """A null id as the largest number, so that it names a class last."""
    return F.coalesce(key.cast("long"), F.lit((1 << 63) - 1))


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: ``_id``, ``_hash`` of the text, ``_n`` shingles, ``_class`` (from the set alone), ``_registers``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            raw, offsets = W.terminated(batch.column(1))
            for low, high in W.chunks(offsets):
                hashes, firsts = distinct_shingles(raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], size)
                codes = registers(hashes, firsts)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))])
                own = W.mix(sums[firsts[1:]] - sums[firsts[:-1]] + np.diff(firsts).astype(np.uint64)).view(np.int64)
                some = np.diff(firsts) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(np.diff(firsts)), pa.array(own, mask=~some),
                     pa.array([c.tobytes() if s else None for c, s in zip(codes, some, strict=True)], pa.binary())],
                    ["_id", "_hash", "_n", "_class", "_registers"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash")).mapInArrow(
        run, "_id long, _hash long, _n long, _class long, _registers binary")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of a sorted partition, cut between groups of equal ``keys`` only."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        last = [held[k][len(held) - 1].as_py() for k in keys]
        if [held[k][0].as_py() for k in keys] == last:
            continue
        same = np.ones(len(held), bool)
        for k, v in zip(keys, last, strict=True):
            same &= held[k].to_numpy() == v
        cut = int(np.flatnonzero(~same)[-1]) + 1
        yield held.slice(0, cut).combine_chunks()
        held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def _pairs(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of pairs of one group whose estimate leaves the threshold possible, with matching registers.

    A pair counts in the first band only that both share, and in the pair of blocks that its classes fall into.
    """
    registers_ = _fixed(rows["_registers"].combine_chunks(), np.uint16, REGISTERS)
    n, own, band = (rows[k].to_numpy() for k in ("_n", "_own", "_band"))
    i, j = rows["_i"].to_numpy(), rows["_j"].to_numpy()
    key = rows["_key"].to_numpy()
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    size = np.diff(np.append(new, len(key)))
    # Partners of each row: the rows after it in its group.
    after = np.repeat(new + size, size) - np.arange(len(key)) - 1
    ends = np.cumsum(after)
    low = 0
    while low < len(key):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(low, high), after[low:high])
        b = np.arange(len(a)) - np.repeat(ends[low:high] - after[low:high] - (ends[low - 1] if low else 0), after[low:high]) + a + 1
        low = high
        for first in range(0, len(a), PAIRS):
            x, y = a[first:first + PAIRS], b[first:first + PAIRS]
            fits = ((own[x] == i[x]) & (own[y] == j[x])) | ((own[y] == i[x]) & (own[x] == j[x]))
            x, y = x[fits], y[fits]
            keep = could_link(registers_[x], registers_[y], n[x], n[y], percent)
            x, y = x[keep], y[keep]
            equal = registers_[x] == registers_[y]
            shared = equal.reshape(len(x), BANDS, ROWS).all(axis=2).argmax(axis=1)
            mine = shared == band[x]
            yield x[mine], y[mine], equal[mine].sum(axis=1)


GROUP = ["_key", "_i", "_j"]
SHAPE = "_key long, _i int, _j int, _band int, _own int, _class long, _n long, _registers binary"


def _participants(groups: DataFrame, percent: int) -> DataFrame:
    """Members that have a pair to be checked in their group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, GROUP):
            take = np.zeros(len(rows), bool)
            for x, y, _ in _pairs(rows, percent):
                take[x] = take[y] = True
            yield from rows.filter(pa.array(take)).to_batches()

    return groups.mapInArrow(run, SHAPE)


def _linked(groups: DataFrame, percent: int) -> DataFrame:
    """Links of each group that join all members whose full sets reach the threshold.

    Pairs come in order of their estimates; a pair whose classes are joined already needs no check.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, GROUP):
            classes, sets = rows["_class"].to_numpy(), rows["_set"].combine_chunks()
            found = [np.concatenate(x) for x in zip(*_pairs(rows, percent), strict=True)]
            if not found:
                continue
            order = np.argsort(-found[2], kind="stable")
            root, opened, links = list(range(len(rows))), {}, []

            def top(k, root=root):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            def full(k, opened=opened, sets=sets):
                if k not in opened:
                    opened[k] = np.frombuffer(sets[k].as_py(), np.uint64)
                return opened[k]

            for x, y in zip(found[0][order].tolist(), found[1][order].tolist(), strict=True):
                p, q = top(x), top(y)
                if p == q:
                    continue
                both = np.concatenate([full(x), full(y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    root[p] = q
                    links.append((classes[x], classes[y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["_a", "_b"])

    return groups.mapInArrow(run, "_a long, _b long")


def _sets(classes: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Full sorted shingle sets of the classes (_class, _pick), from one document of each."""
    wanted = materialise(classes.select("_class", "_pick._id", "_pick._hash"), "wanted")
    texts = docs.select(_known(F.col(id_col)).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    texts = lookup_join(texts, wanted, ["_id", "_hash"], salt=F.length("_text"), fits=is_small(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            raw, offsets = W.terminated(batch.column(batch.schema.get_field_index("_text")))
            of = batch.column(batch.schema.get_field_index("_class"))
            for low, high in W.chunks(offsets):
                hashes, firsts = distinct_shingles(raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], size)
                yield pa.RecordBatch.from_arrays(
                    [of.slice(low, high - low), pa.array([hashes[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary())],
                    ["_class", "_set"])

    return materialise(texts.mapInArrow(run, "_class long, _set binary").dropDuplicates(["_class"]), "sets")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept (the id is the component's), text_hash, chosen.

    ``chosen`` is true for one id and text of each component, the smallest id (null last) and then the smallest hash; rows that
    repeat both are all chosen. Linked are documents whose sets of ``size`` words share ``percent`` percent of their union.
    """
    rows = materialise(signatures(docs, size, id_col, text_col), "signatures")
    # Rows in the order in which one of them stands for its class or component.
    pick = F.struct(F.col("_id").isNull().alias("_none"), _known(F.col("_id")).alias("_id"), "_hash")
    # Classes of equal sets; partial counts keep a text with very many copies in no single task.
    classes = materialise(rows.filter("_class is not null").groupBy("_class").agg(
        F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows"), F.first("_n").alias("_n"), F.first("_registers").alias("_registers"),
        F.min(pick).alias("_pick")), "classes")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("_registers", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])
    banded = classes.select("_class", F.posexplode(keys).alias("_band", "_key"))
    sizes = banded.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    sizes = materialise(sizes.withColumn("_blocks", F.ceil(F.col("_m") / BLOCK_CLASSES).cast("int")).drop("_m"), "bands")
    members = materialise(lookup_join(banded, sizes, ["_key"], salt=F.col("_class"), fits=is_small(sizes)), "members")
    # A large group is cut into blocks; every pair of blocks is a group of its own.
    own = F.pmod(F.xxhash64("_class"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    placed = members.withColumn("_own", own).withColumn("_other", other).select(
        "_key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_band", "_own", "_class")
    # A class is in at most one group per band and block, so this join has no hot key.
    placed = placed.join(classes.select("_class", "_n", "_registers"), "_class")
    grouped = placed.select(*[f.split()[0] for f in SHAPE.split(", ")]).repartition(*GROUP).sortWithinPartitions(*GROUP)
    checked = materialise(_participants(grouped, percent), "participants")
    involved = checked.select("_class").distinct().join(classes.select("_class", "_pick"), "_class")
    full = _sets(involved, docs, size, id_col, text_col)
    links = materialise(_linked(checked.join(full, "_class").repartition(*GROUP).sortWithinPartitions(*GROUP), percent), "links")
    # The smallest id of each component; classes of one row without links name themselves.
    linked = components(links).select(F.col("node").alias("_class"), F.col("component").alias("_part"))
    named = classes.join(linked, "_class", "left").filter("_rows > 1 or _part is not null")
    named = named.select("_class", "_least", "_pick", F.coalesce("_part", "_class").alias("_part"))
    names = named.groupBy("_part").agg(F.min("_least").alias("_component"), F.min("_pick").alias("_chosen"))
    named = materialise(lookup_join(named, names, ["_part"], salt=F.col("_class"), fits=False, salts=8).select("_class", "_component", "_chosen"), "named")
    out = lookup_join(rows.select("_id", "_hash", "_n", "_class"), named.withColumn("_named", F.lit(True)), ["_class"], "left", salt=F.xxhash64("_id"), fits=is_small(named))
    component = F.when(F.col("_named"), F.col("_component")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"),
                      F.col("_id").eqNullSafe(component).alias("kept"), F.col("_hash").alias("text_hash"),
                      F.when(F.col("_named"), pick == F.col("_chosen")).otherwise(F.lit(True)).alias("chosen"))
