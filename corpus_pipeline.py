"""The training-data pipeline: each stage works on all that the stage before it kept.

A null id is kept apart from all others; rows that share an id are judged by their own texts. Empty tables pass through. Texts of
any length are worked on whole. Columns beside ``COLUMNS`` don't go beyond the first stage, so none can clash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvault.llm import language, near_duplicates, packing, suffix_dedup, tiling
from docvault.session import bounded_batches, is_small, lookup_join, materialise

LEAST_LANGUAGE_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keys(text_hash: Column) -> dict[str, Column]:
    """What tells rows apart: the id, null or not, and the text."""
    return {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "text_hash": text_hash}


def _without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose keys aren't in ``gone``; the text moves only where ``gone`` is too large to broadcast."""
    gone = materialise(gone.distinct(), "gone")
    return lookup_join(docs.withColumns(keys), gone, list(keys), "left_anti", fits=is_small(gone)).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that the network can't tell (score under ``LEAST_LANGUAGE_SCORE``)."""
    bounded_batches(spark)
    network, languages = language.train(docs)
    found = language.identify(docs, network, languages, keep=("text", "lang", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: of the smallest id, null last, and of its texts one; of repeated rows one stays."""
    bounded_batches(spark)
    own = _keys(F.xxhash64("text"))
    names = list(own)
    found = near_duplicates.near_duplicates(docs).select(*[c.alias(k) for k, c in _keys(F.col("text_hash")).items()], "chosen")
    found = materialise(found, "chosen")
    left = _without(docs, found.filter("not chosen").select(names), own)
    again = materialise(found.filter("chosen").groupBy(names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(names), "again")
    if again.isEmpty():
        return left
    keyed = left.withColumns(own)
    few = is_small(again)
    once = lookup_join(keyed, again, names, "left_anti", fits=few)
    repeated = lookup_join(keyed, again, names, "left_semi", fits=few).dropDuplicates(names)
    return once.unionByName(repeated).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that a document with a smaller id holds; texts with nothing left go."""
    bounded_batches(spark)
    found = suffix_dedup.remove_repeats(docs, carry=("lang", "source"), texts=True)
    return found.filter(F.trim("text") != "").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold most of a test item, whole or in another order."""
    bounded_batches(spark)
    found = tiling.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(*[c.alias(k) for k, c in _keys(F.col("text_hash")).items()])
    return _without(docs, gone, _keys(F.xxhash64("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 ids, with the ids of each piece."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, ids=True)


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("repeats", without_repeats), ("decontamination", without_tests), ("packing", packed)]
# Networks, tokenizers and tilings are beyond SQL; tests/llm compares the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
