"""Lexical search with dynamic pruning: postings in blocks that carry the largest score part in them.

Passages are numbered into ranges of ``RANGE``; a block holds a term's postings within one range, the largest BM25 part
among them (without the term's rarity) and the union of their access masks. A question adds up the largest parts of
its terms over each range: no passage of the range can score more. The best ranges are scored first; the ``n``-th best score found there
is a floor, and only ranges whose bound reaches it are scored. The result is that of ``lexical.lexical_top``, row for row.

Blocks are stored in term order, so a batch of questions reads row groups of its terms only; bounds are taken from three narrow
columns, and the postings themselves are unpacked for surviving blocks alone. Everything is a join or an aggregate: a term
found everywhere is spread over its ranges, and questions are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.text import run_lengths
from docvault.operators.access import allows
from docvault.operators.lexical import PASSAGE, only_terms
from docvault.operators.ranking import top_per_question
from docvault.session import is_small, lookup_join, materialise

RANGE = 8                   # passages of a range
SLACK = 1e-8                # scores are rounded to nine decimals
BLOCK = ["coll", "term", "range"]


def counted_index(index: DataFrame, number: Column | None = None, size: int = RANGE) -> DataFrame:
    """Passages of a lexical index with their terms counted and their range; neither text nor tokens go along.

    ``number`` numbers the passages; by default they are numbered as they are read. Passages that are read together often share
    an origin, which helps the bounds; any numbering gives the same search results.
    """
    number = F.monotonically_increasing_id() if number is None else number
    return index.select(*PASSAGE, "mask", "superseded", "length", run_lengths(F.col("tokens")).alias("counts"),
                        F.floor(number / size).alias("range"))


def part(tf: Column, length: Column, mean_length: Column) -> Column:
    """A term's share of a BM25 score, before its weight."""
    return tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * length / mean_length))


def block_postings(counted: DataFrame, stats: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Blocks (coll, term, range, top, masks, passages, postings) in term order. ``stats`` has one row a collection.

    With ``terms``, only blocks of the terms that some question asks for: all that a search of this one batch reads.

    A block's postings are at most ``RANGE`` of each collection. Dealing by term and range serves both the grouping and the
    order, so postings move once.
    """
    rows = counted.join(F.broadcast(stats) if is_small(stats) else stats, "coll")
    rows = rows.select(*PASSAGE, "mask", "superseded", "length", "mean_length", "range", F.explode("counts").alias("c"))
    if terms is not None:
        rows = only_terms(rows.withColumn("term", F.col("c.term")), terms)
    rows = rows.select("coll", F.col("c.term").alias("term"), "range", "mask", part(F.col("c.tf"), F.col("length"), F.col("mean_length")).alias("part"),
                       F.struct("doc", "n", "mask", "superseded", part(F.col("c.tf"), F.col("length"), F.col("mean_length")).alias("part")).alias("posting"))
    dealt = rows.repartitionByRange("term", "range")
    blocks = dealt.groupBy("term", "range", "coll").agg(F.max("part").alias("top"), F.bit_or("mask").alias("masks"), F.count(F.lit(1)).alias("passages"),
                                                        F.collect_list("posting").alias("postings"))
    return blocks.sortWithinPartitions("term", "range").select(*BLOCK, "top", "masks", "passages", "postings")


def rarity(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """(coll, term, idf) from the blocks' numbers of passages; postings aren't read."""
    df = blocks.groupBy("coll", "term").agg(F.sum("passages").alias("df"))
    return (df.join(F.broadcast(stats) if is_small(stats) else stats, "coll")
            .select("coll", "term", F.log(1 + (F.col("passages") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))


class BlockSearch:
    """A batch of questions over blocks: ``bounds`` of all ranges, ``floor`` per question, ``alive`` ranges, ``top`` passages."""

    def __init__(self, blocks: DataFrame, rare: DataFrame, terms: DataFrame, n: int, first_ranges: int | None = None):
        self.n, self.blocks = n, only_terms(blocks, terms)
        weighted = terms.join(only_terms(rare, terms), ["coll", "term"]).select("qid", "bit", "coll", "term", (F.col("weight") * F.col("idf")).alias("weight"))
        self.weighted = materialise(weighted, "weighted-terms")
        self.fits = is_small(self.weighted)
        narrow = self._asked(self.blocks.select(*BLOCK, "top", "masks").filter("masks <> 0"))
        bounds = narrow.filter(allows(F.col("masks"), F.col("bit"))).groupBy("qid", "coll", "range").agg(
            F.round(F.sum(F.col("weight") * F.col("top")), 9).alias("bound"), F.count(F.lit(1)).alias("blocks"))
        self.bounds = materialise(bounds, "bounds")
        few = 2 * n if first_ranges is None else first_ranges  # so that a floor is found where only some passages are permitted
        first = top_per_question(self.bounds.select("*", F.col("range").alias("doc"), F.lit(0).alias("n")), "bound", few, ["qid", "coll"])
        tried = top_per_question(self._scored(first.select("qid", "coll", "range")), "bm25", n, ["qid", "coll"])
        self.floor = materialise(tried.filter(F.col("rank") == n - 1).select("qid", "coll", F.col("bm25").alias("floor")), "floors")
        # Without n passages there is no floor yet, so all ranges stay.
        alive = lookup_join(self.bounds, self.floor, ["qid", "coll"], "left")
        self.alive = materialise(alive.filter(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))).select("qid", "coll", "range", "blocks"), "alive")

    def _asked(self, blocks: DataFrame) -> DataFrame:
        """Blocks with the questions that ask for their term."""
        return lookup_join(blocks, self.weighted, ["coll", "term"], salt=F.xxhash64("range"), fits=self.fits)

    def _scored(self, ranges: DataFrame) -> DataFrame:
        """Exact scores of the permitted passages of some (qid, coll, range): (qid, coll, doc, n, superseded, bm25)."""
        ranges = materialise(ranges, "ranges")
        wanted = lookup_join(self._asked(self.blocks), ranges, ["qid", "coll", "range"], fits=is_small(ranges))
        rows = wanted.select("qid", "bit", "coll", "weight", F.explode("postings").alias("p"))
        rows = rows.filter(allows(F.col("p.mask"), F.col("bit")))
        rows = rows.select("qid", "coll", F.col("p.doc").alias("doc"), F.col("p.n").alias("n"), F.col("p.superseded").alias("superseded"),
                           (F.col("weight") * F.col("p.part")).alias("part"))
        return rows.groupBy("qid", *PASSAGE, "superseded").agg(F.round(F.sum("part"), 9).alias("bm25")).filter("bm25 > 0")

    def top(self) -> DataFrame:
        """The best ``n`` passages per question and collection, ``rank`` from 0."""
        return top_per_question(self._scored(self.alive.select("qid", "coll", "range")), "bm25", self.n, ["qid", "coll"])

    def work(self) -> DataFrame:
        """(qid, coll, blocks, scored_blocks): blocks of a question's terms, and those that had to be unpacked at the end."""
        every = self.bounds.groupBy("qid", "coll").agg(F.sum("blocks").alias("blocks"))
        left = self.alive.groupBy("qid", "coll").agg(F.sum("blocks").alias("scored_blocks"))
        return every.join(left, ["qid", "coll"], "left").withColumn("scored_blocks", F.coalesce("scored_blocks", F.lit(0)))
