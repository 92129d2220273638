"""Collocations: phrases of two and three words that occur more often than their parts suggest.

First pass. Each task counts the n-grams of a bounded block of text. N-grams are dealt to hash partitions by the high half of a
64-bit hash and named there by the low half. A partition keeps a Misra-Gries summary: counters are added up, and when there are more
than its capacity, the largest count beyond it is taken from all and what falls to zero goes. The capacity exceeds the
partition's mass divided by the threshold, so in all less than the threshold is ever taken from a counter: every
n-gram that is frequent enough survives, along with some that aren't. Summaries merge, so the order of blocks doesn't matter. Masses are
sent ahead of the counts. The number of partitions grows with the corpus and the memory of each is bounded.

Second pass. A Bloom filter of the survivors picks n-grams, whose words and language are then counted exactly. What the filter
lets through by chance is counted as well and falls at the threshold, so hashes never decide about a result. The filter has at
most ``FILTER_BITS`` bits; in a corpus too large for it more n-grams are counted, never fewer.

Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they occur, null ids don't matter.
Very long texts and words are treated whole. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvault.llm import words as W
from docvault.llm.pieces import expand
from docvault.llm.tally import Tally
from docvault.session import is_small, lookup_join, materialise

LEAST = 10                  # occurrences of a phrase
TOP = 2000                  # phrases of a language
COVERED = 50                # percent of a phrase's occurrences inside a longer one that drop it
UNKNOWN = "und"
CAPACITY = 1 << 18          # counters of a summary, by the expected mass of a partition
HELD_GRAMS = 1 << 22        # n-grams counted together in a task
FILTER_BITS = 1 << 29
BITS_EACH = 16              # bits of the filter for each survivor, up to FILTER_BITS
_BLOCK = 1 << 13            # bytes of the filter that are merged together
_SPLITS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_GAPS = np.isin(np.arange(256), [0x20, 0x09])


class Words:
    """The words of a run of texts: hashes, language codes, and text joined by single spaces."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, code: np.ndarray, seeds: np.ndarray):
        low = W.lowered(raw)
        split = _SPLITS[low]
        inside = ~(split | _GAPS[low])
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[0::2], edges[1::2]
        self.count = len(starts)
        self.code = code[np.searchsorted(offsets, starts, "right") - 1]
        self.piece = np.cumsum(split)[starts] if self.count else starts
        self.hashes, self.seeds = W.span_hashes(low, starts, ends), seeds
        low[ends] = 0x20
        sizes = ends - starts + 1
        self.text, self.at = expand(starts, sizes, low), np.concatenate([[0], np.cumsum(sizes)])

    def firsts(self, size: int) -> np.ndarray:
        """First words of all phrases of ``size`` words."""
        if self.count < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[size - 1:] == self.piece[:self.count - size + 1])

    def names(self, first: np.ndarray, size: int, partitions: int) -> np.ndarray:
        """Partition (high half) and name (low half) of phrases."""
        state = W.mix(self.seeds[self.code[first]] ^ self.hashes[first])
        for k in range(1, size):
            state = W.mix(state * np.uint64(3) + self.hashes[first + k] + np.uint64(k))
        return ((state >> np.uint64(32)) % np.uint64(partitions) << np.uint64(32)) | (state & np.uint64(0xFFFFFFFF))

    def counts(self, first: np.ndarray, size: int, langs: pa.Array) -> pa.Table:
        """``lang``, ``phrase``, ``n`` of phrases."""
        low, high = self.at[first], self.at[first + size] - 1
        data, at = expand(low, high - low, self.text), np.concatenate([[0], np.cumsum(high - low)])
        phrase = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        found = pa.table({"code": self.code[first], "phrase": phrase}).group_by(["code", "phrase"]).aggregate([([], "count_all")])
        return pa.table({"lang": langs.take(found["code"].combine_chunks()), "phrase": found["phrase"], "n": found["count_all"]})


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """Words of bounded runs of texts with the languages that their codes stand for."""
    for batch in W.slices(batches):
        coded = batch.column(0).dictionary_encode()
        langs, code = coded.dictionary, coded.indices.to_numpy()
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in langs.to_pylist()], np.uint64)
        raw, offsets = W.terminated(batch.column(1))
        for low, high in W.chunks(offsets):
            yield Words(raw[offsets[low]:offsets[high]], offsets[low:high] - offsets[low], code[low:high], seeds), langs


_COUNTED = "lang string, phrase string, n long"


def _counted_schema() -> pa.Schema:
    return pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (a word) and ``n`` of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(_counted_schema())
        for own, langs in _words(batches):
            tally.add(own.counts(np.arange(own.count), 1, langs))
            yield from tally.full()
        yield from tally.rest()

    return texts.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class Summary:
    """Misra-Gries counters of one partition: sorted names, counts, and what was taken from every counter."""

    def __init__(self, mass: int, least: int):
        self.capacity, self.least, self.taken = mass // least + 1, least, 0
        self.names, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, names: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((names, counts))
        self.size += len(names)
        if self.size > max(self.capacity, 1 << 16):
            self.fold()

    def fold(self) -> None:
        names = np.concatenate([self.names, *(n for n, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c.astype(np.int64) for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        if not len(names):
            return
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        names, counts = names[heads], np.add.reduceat(counts, heads)
        if len(names) > self.capacity:
            beyond = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            counts = counts - beyond
            names, counts = names[counts > 0], counts[counts > 0]
            self.taken += beyond
        self.names, self.counts = names, counts

    def survivors(self) -> np.ndarray:
        """Names that may have the least count."""
        self.fold()
        return self.names[self.counts + self.taken >= self.least]


def summarise(texts: DataFrame, sizes: tuple[int, ...], least: int, partitions: int) -> DataFrame:
    """``partition``, ``n`` and packed ``names`` of all phrases that may occur ``least`` times."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = np.uint8 if least < 256 else np.uint32
    block = HELD_GRAMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("partition", pa.int64()), ("part", pa.int32()), ("mass", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])
        masses, held, size = {}, [], 0

        def flush():
            every = np.sort(np.concatenate(held))
            heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            # A block that alone reaches the least count decides; more would only add to the mass.
            counts = np.minimum(np.diff(np.append(heads, len(every))), least)
            every = every[heads]
            of = (every >> np.uint64(32)).astype(np.int64)
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            names, packed, own = every.astype(np.uint32), counts.astype(kind), of[begins].tolist()
            for p, m in zip(own, np.add.reduceat(counts, begins).tolist(), strict=True):
                masses[p] = masses.get(p, 0) + m
            edges = [*begins.tolist(), len(of)]
            for k in range(0, len(own), 256):
                n = len(own[k:k + 256])
                spans = [slice(a, b) for a, b in zip(edges[k:k + n], edges[k + 1:k + n + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own[k:k + n]), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int64()),
                                                  pa.array([names[s].tobytes() for s in spans], pa.binary()),
                                                  pa.array([packed[s].tobytes() for s in spans], pa.binary())], schema=schema)

        for own, _ in _words(batches):
            for k in sizes:
                held.append(own.names(own.firsts(k), k, partitions))
                size += len(held[-1])
            if size > block:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
        if masses:
            n = len(masses)
            yield pa.RecordBatch.from_arrays([pa.array(list(masses)), pa.array([0] * n, pa.int32()), pa.array(list(masses.values())),
                                              pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, summary, mass = None, None, 0

        def done():
            found = np.zeros(0, np.uint32) if summary is None else summary.survivors()
            yield pa.RecordBatch.from_pydict({"partition": pa.array([partition]), "n": pa.array([len(found)], pa.int64()), "names": pa.array([found.tobytes()], pa.binary())})

        for batch in batches:
            for p, part, m, names, counts in zip(*(batch.column(k) for k in range(5)), strict=True):
                if p.as_py() != partition:
                    if partition is not None:
                        yield from done()
                    partition, summary, mass = p.as_py(), None, 0
                if part.as_py() == 0:  # masses come first
                    mass += m.as_py()
                    continue
                if summary is None:
                    summary = Summary(mass, least)
                summary.add(np.frombuffer(names.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), kind))
        if partition is not None:
            yield from done()

    counted = texts.mapInArrow(count, "partition long, part int, mass long, names binary, counts binary")
    dealt = counted.repartition(min(tasks, partitions), "partition").sortWithinPartitions("partition", "part")
    return dealt.mapInArrow(merge, "partition long, n long, names binary")


def _places(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter."""
    h = W.mix(names)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def survivor_filter(survivors: DataFrame, least_bits: int = 8 * _BLOCK) -> np.ndarray:
    """Bloom filter of all survivors, of bounded size: bytes."""
    total = survivors.agg(F.sum("n")).first()[0] or 0
    bits = least_bits
    while bits < min(FILTER_BITS, BITS_EACH * total):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for p, names in zip(batch.column(0), batch.column(1), strict=True):
                every = np.frombuffer(names.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(p.as_py() << 32)
                for place in _places(every, bits):
                    np.bitwise_or.at(own, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        rows = own.reshape(-1, _BLOCK)
        for k in np.flatnonzero(rows.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "bits": pa.array([rows[k].tobytes()], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, None
        for batch in batches:
            for k, more in zip(batch.column(0), batch.column(1), strict=True):
                if k.as_py() != block:
                    if block is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bits": pa.array([own.tobytes()], pa.binary())})
                    block, own = k.as_py(), np.zeros(_BLOCK, np.uint8)
                own |= np.frombuffer(more.as_buffer(), np.uint8)
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bits": pa.array([own.tobytes()], pa.binary())})

    tasks = int(survivors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = survivors.select("partition", "names").mapInArrow(mark, "block long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    # At most FILTER_BITS / 8 bytes in all.
    for row in marked.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(join, "block long, bits binary").toLocalIterator():
        out[row.block * _BLOCK:(row.block + 1) * _BLOCK] = np.frombuffer(row.bits, np.uint8)
    return out


def count_phrases(texts: DataFrame, sizes: tuple[int, ...], least: int, partitions: int, filter_: np.ndarray) -> DataFrame:
    """``lang``, ``phrase``, exact ``n`` of all phrases with at least ``least`` occurrences."""
    sent, bits = texts.sparkSession.sparkContext.broadcast(filter_), 8 * len(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, tally = sent.value, Tally(_counted_schema())
        for own, langs in _words(batches):
            for k in sizes:
                first = own.firsts(k)
                for place in _places(own.names(first, k, partitions), bits):
                    # Only the places of n-grams that passed so far are looked up.
                    if len(place) != len(first):
                        place = place[hit]
                    hit = marks[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
                    first = first[hit]
                tally.add(own.counts(first, k, langs))
            yield from tally.full()
        yield from tally.rest()

    return texts.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_phrases(texts: DataFrame, words: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = LEAST) -> DataFrame:
    """``lang``, ``phrase``, ``n`` by both passes. ``words`` has the number ``n`` of all words."""
    total = words.agg(F.sum("n")).first()[0] or 0
    partitions = max(1, -(-total * len(sizes) // (least * CAPACITY)))
    survivors = materialise(summarise(texts, sizes, least, partitions), "survivors")
    return count_phrases(texts, sizes, least, partitions, survivor_filter(survivors))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly: numbers up to 18 digits in decimals."""
    return F.expr(f"(1000000 * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))) div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))")


def top_of_each(rows: DataFrame, key: str, order: list[Column], salt: Column, top: int, fan: int = 32) -> DataFrame:
    """The first ``top`` rows of each key with their ``rank``, by a tree of groups, so that no group is larger than a share of
    the first level or ``fan * top`` rows."""
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_s", F.pmod(salt, F.lit(groups)))
    while True:
        w = Window.partitionBy(key, "_s").orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
        if groups == 1:
            return rows.drop("_s")
        groups = -(-groups // fan)
        rows = rows.withColumn("_s", F.pmod(F.col("_s"), F.lit(groups)))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the first ``top`` phrases of each language."""
    texts = _texts(docs, lang_col, text_col)
    words = materialise(count_words(texts), "words")
    phrases = materialise(frequent_phrases(texts, words, least=least).withColumn("w", F.split("phrase", " ", -1)), "phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # Parts of a frequent phrase are as frequent. Keys are unique on this side.
    single = materialise(words.filter(F.col("n") >= least), "single")
    fits = is_small(single)

    def with_count(rows: DataFrame, part: Column, name: str, counts: DataFrame, fits: bool) -> DataFrame:
        # A part of very many phrases is left to the adaptive skew join where the other side is too large for a broadcast.
        side = counts.select("lang", F.col("phrase").alias("_part"), F.col("n").alias(name))
        return lookup_join(rows.withColumn("_part", part), side, ["lang", "_part"], fits=fits).drop("_part")

    two = phrases.filter(F.size("w") == 2)
    three = phrases.filter(F.size("w") == 3)
    head, tail = F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2])
    inside = three.select("lang", F.explode(F.array(head, tail)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    kept = two.join(inside, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("n"))).drop("_longer")
    kept = with_count(with_count(kept.withColumnRenamed("n", "a"), F.col("w")[0], "l", single, fits), F.col("w")[1], "r", single, fits)
    kept = kept.withColumn("score", _score("a", "l", "r"))
    pairs = is_small(two)
    for part, name, counts, small in ((F.col("w")[0], "l", single, fits), (tail, "r", two, pairs), (head, "l2", two, pairs), (F.col("w")[2], "r2", single, fits)):
        three = with_count(three.withColumnRenamed("n", "a"), part, name, counts, small)
    three = three.withColumns({"score": _score("a", "l", "r"), "score2": _score("a", "l2", "r2")})
    later = F.col("score2") < F.col("score")
    three = three.select("lang", "phrase", "a", F.when(later, F.col("l2")).otherwise(F.col("l")).alias("l"),
                         F.when(later, F.col("r2")).otherwise(F.col("r")).alias("r"), F.least("score", "score2").alias("score"))
    found = top_of_each(kept.select(*three.columns).unionByName(three), "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()],
                        F.xxhash64("phrase"), top)
    # One row a language, and at most ``top`` on the other side.
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
