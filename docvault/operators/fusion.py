"""Reciprocal rank fusion, the penalty for superseded versions, and the merge with session uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.operators.ranking import top_per_question

KEY = ["qid", "coll", "doc", "n", "superseded"]


def candidates_per_list(k: int = V.TOP_K) -> int:
    return max(4 * k, 20)


def _vote(rank: str) -> Column:
    return F.coalesce(1.0 / (V.RRF_K + F.col(rank)), F.lit(0.0))


def fuse(lexical: DataFrame | None, dense: DataFrame | None) -> DataFrame:
    """Fused candidates with ``score``; give one list for a single-method search.

    A passage missing from a list gets nothing from it; superseded documents are marked down.
    """
    none_int, none_num = F.lit(None).cast("int"), F.lit(None).cast("double")
    if lexical is not None:
        lexical = lexical.select(*KEY, "bm25", F.col("rank").alias("rank_bm25"))
    if dense is not None:
        dense = dense.select(*KEY, "dense", F.col("rank").alias("rank_dense"))
    if lexical is None:
        both = dense.withColumns({"bm25": none_num, "rank_bm25": none_int})
    elif dense is None:
        both = lexical.withColumns({"dense": none_num, "rank_dense": none_int})
    else:
        both = lexical.join(dense, KEY, "full_outer")
    factor = F.when(F.col("superseded"), V.SUPERSEDED_FACTOR).otherwise(1.0)
    return both.withColumn("score", F.round((_vote("rank_bm25") + _vote("rank_dense")) * factor, 12)).withColumns(
        {"bm25": F.coalesce("bm25", F.lit(0.0)), "dense": F.coalesce("dense", F.lit(0.0))})


def final_hits(fused: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """Top ``k`` of each collection, then of both together; ``rank`` from 0."""
    per_collection = top_per_question(fused, "score", k, ["qid", "coll"], "coll_rank").drop("coll_rank")
    return top_per_question(per_collection, "score", k, ["qid"])
