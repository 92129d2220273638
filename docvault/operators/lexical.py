"""Lexical search: BM25 over passages, filtered by permission before anything is scored.

Statistics (passage count, mean length, document frequency) cover the whole collection, locked passages
included, so a score does not depend on who asks. A collection is the library or one session's uploads.

Plan: a passage's terms are counted within its row, so nothing moves before scoring. The counts of question terms are
written once and give both the document frequencies and the scores; passages' lengths are read a second time for their
mean. Top-k is cut inside each task before the exchange by question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.text import run_lengths, tokens
from docvault.operators import glossary
from docvault.operators.access import allows, role_bit
from docvault.operators.ranking import top_per_question
from docvault.session import is_small, lookup_join, materialise

PASSAGE = ["coll", "doc", "n"]
MAX_LISTED_TERMS = 2000


def indexed_text(section: Column, text: Column) -> Column:
    return F.concat(section, F.lit(". "), text)


def lexical_index(passages: DataFrame) -> DataFrame:
    """Passages with their terms in order and their length; what a library build stores."""
    terms = tokens(indexed_text(F.col("section"), F.col("text")))
    return passages.withColumn("tokens", terms).withColumn("length", F.size("tokens"))


def collection_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("coll").agg(F.count(F.lit(1)).alias("passages"), F.avg("length").alias("mean_length"))


def idf(passages: Column, df: Column) -> Column:
    return F.log(1 + (passages - df + 0.5) / (df + 0.5))


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, bit, coll, term, weight) for rows of (qid, q, role[, sid]): own words weigh 1, expansions less.

    Every question searches the library, and its session's uploads when it has a session.
    """
    colls = [F.lit("library")] + ([F.col("sid")] if "sid" in questions.columns else [])
    base = questions.select(
        "qid", role_bit(F.col("role")).alias("bit"), F.array_compact(F.array(*colls)).alias("colls"),
        tokens("q").alias("own"))
    both = base.withColumn("extra", F.array_distinct(glossary.expansion("own")))
    weighted = F.concat(
        F.transform(F.array_distinct("own"), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight"))),
        F.transform("extra", lambda t: F.struct(t.alias("term"), F.lit(V.EXPANSION_WEIGHT).alias("weight"))))
    rows = both.select("qid", "bit", "colls", F.explode(weighted).alias("t"))
    return rows.select("qid", "bit", F.explode("colls").alias("coll"), "t.term", "t.weight")


def only_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of the terms some question asks for.

    Few terms become a literal list, which reaches the Parquet scan and skips row groups of other terms.
    """
    wanted = terms.select("term").distinct()
    listed = [r["term"] for r in wanted.limit(MAX_LISTED_TERMS + 1).collect()]
    if len(listed) <= MAX_LISTED_TERMS:
        return rows.filter(F.col("term").isin(listed) if listed else F.lit(False))
    return lookup_join(rows, wanted, ["term"], "left_semi")


def term_counts(index: DataFrame, terms: DataFrame | None = None, fits: bool | None = None) -> DataFrame:
    """Postings (coll, doc, n, mask, superseded, length, term, tf), of all terms or those of ``terms``; counted in the row."""
    rows = index.select(*PASSAGE, "mask", "superseded", "length", F.explode(run_lengths(F.col("tokens"))).alias("c"))
    rows = rows.select(*PASSAGE, "mask", "superseded", "length", "c.term", "c.tf")
    if terms is not None:
        rows = lookup_join(rows, terms.select("term").distinct(), ["term"], "left_semi", salt=F.xxhash64("doc", "n"), fits=fits)
    return rows


def stored_order(postings: DataFrame) -> DataFrame:
    """Postings in term order for storage; the passage in the range key splits a term found everywhere."""
    return postings.repartitionByRange("term", F.xxhash64("doc", "n")).sortWithinPartitions("term")


def rarity(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(coll, term, idf) of postings; a term has one posting per passage."""
    df = counts.groupBy("coll", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(stats), "coll").select("coll", "term", idf(F.col("passages"), F.col("df")).alias("idf"))


def scores(counts: DataFrame, rare: DataFrame, stats: DataFrame, terms: DataFrame, fits: bool) -> DataFrame:
    """BM25 of every permitted passage that shares a term with a question: (qid, coll, doc, n, superseded, bm25).

    ``counts`` are the postings of the question terms in all passages; ``rare`` holds their
    (coll, term, idf); ``fits`` tells whether the question terms are few enough to be broadcast.
    """
    # collections are the library and the live sessions, a capped number
    weighted = (terms.join(rare.select("coll", "term", "idf"), ["coll", "term"]).join(F.broadcast(stats), "coll")
                .select("qid", "bit", "coll", "term", "mean_length", (F.col("weight") * F.col("idf")).alias("weight")))
    matched = lookup_join(counts, weighted, ["coll", "term"], salt=F.xxhash64("doc", "n"), fits=fits)
    matched = matched.filter(allows(F.col("mask"), F.col("bit")))
    part = F.col("weight") * F.col("tf") * (V.BM25_K1 + 1) / (
        F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("length") / F.col("mean_length")))
    return matched.groupBy("qid", *PASSAGE, "superseded").agg(F.round(F.sum(part), 9).alias("bm25")).filter("bm25 > 0")


def lexical_top(index: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """The best ``n`` passages per question and collection, ``rank`` from 0, straight from an index."""
    fits, stats = is_small(terms), materialise(collection_stats(index), "collection-stats")
    counts = materialise(term_counts(index, terms, fits), "question-postings")
    scored = scores(counts, rarity(counts, stats), stats, terms, fits)
    return top_per_question(scored, "bm25", n, ["qid", "coll"])


def lexical_top_stored(postings: DataFrame, vocab: DataFrame, stats: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """The same from stored postings and vocabulary: only row groups of question terms are read."""
    counts = only_terms(postings, terms).repartition("doc", "n")
    scored = scores(counts, only_terms(vocab, terms), stats, terms, is_small(terms))
    return top_per_question(scored, "bm25", n, ["qid", "coll"])
