"""Block-max search against plain lexical search, and its bounds against the scores they bound."""

import random

import pytest
from pyspark.sql import functions as F

from docvault.operators import block_max, lexical


def _index(spark, seed, n=400):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{int(draw.paretovariate(0.7)) % 300}x" for _ in range(draw.randint(0, 60))]
        rows.append((draw.choice(["library", "library", "s1"]), f"d{k // 3}", k % 3, "", "", " ".join(words), draw.choice([0, 1, 2, 3, 63]), draw.random() < 0.2))
    return lexical.lexical_index(spark.createDataFrame(rows, "coll string, doc string, n int, title string, section string, text string, mask int, superseded boolean")).cache()


def _questions(spark, seed, n=25):
    draw = random.Random(seed + 1)
    rows = [(k, " ".join(f"w{int(draw.paretovariate(0.5)) % 300}x" for _ in range(draw.randint(0, 9))), draw.choice(["employee", "hr", "executive"]), draw.choice([None, "s1"]))
            for k in range(n)]
    return lexical.question_terms(spark.createDataFrame(rows, "qid long, q string, role string, sid string"))


@pytest.mark.parametrize("size,n,first", [(1, 3, 1), (4, 5, None), (8, 20, 2), (1000, 5, 1)])
def test_same_rows_as_lexical_search(spark, size, n, first):
    index, terms = _index(spark, size), _questions(spark, size)
    stats = lexical.collection_stats(index)
    blocks = block_max.block_postings(block_max.counted_index(index, size=size), stats).cache()
    assert blocks.agg(F.max(F.size("postings"))).first()[0] <= size
    found = block_max.BlockSearch(blocks, block_max.rarity(blocks, stats), terms, n, first)
    shown = ["qid", "coll", "doc", "n", "superseded", "bm25", "rank"]
    want = {tuple(r) for r in lexical.lexical_top(index, terms, n).select(*shown).collect()}
    assert {tuple(r) for r in found.top().select(*shown).collect()} == want
    # No passage scores more than its range's bound, and skipped ranges hold none of the best.
    ranges = block_max.counted_index(index, size=size).select("coll", "doc", "n", "range")
    scored = lexical.lexical_top(index, terms, 10**6).join(ranges, ["coll", "doc", "n"]).join(found.bounds, ["qid", "coll", "range"], "left")
    assert scored.filter("bound is null or bm25 > bound + 1e-8").count() == 0
    work = found.work().collect()
    assert all(0 <= r.scored_blocks <= r.blocks for r in work)


def test_rarity_is_that_of_the_collection(spark):
    index = _index(spark, 5)
    stats = lexical.collection_stats(index)
    blocks = block_max.block_postings(block_max.counted_index(index), stats)
    want = lexical.rarity(lexical.term_counts(index), stats)
    assert block_max.rarity(blocks, stats).exceptAll(want).count() == 0 and want.count() > 0


def test_blocks_of_asked_terms_give_the_same_search(spark):
    index, terms = _index(spark, 7), _questions(spark, 7)
    stats, counted = lexical.collection_stats(index), block_max.counted_index(index)
    every, asked = block_max.block_postings(counted, stats).cache(), block_max.block_postings(counted, stats, terms).cache()
    assert 0 < asked.count() < every.count() and asked.select("term").distinct().join(terms, "term", "left_anti").count() == 0
    found = [{tuple(r) for r in block_max.BlockSearch(b, block_max.rarity(b, stats), terms, 5).top().collect()} for b in (every, asked)]
    assert found[0] == found[1] != set()


def test_nothing_found(spark):
    index = _index(spark, 6)
    stats = lexical.collection_stats(index)
    blocks = block_max.block_postings(block_max.counted_index(index), stats)
    rare = block_max.rarity(blocks, stats)
    nobody = spark.createDataFrame([(1, "zzz", "employee")], "qid long, q string, role string")
    assert block_max.BlockSearch(blocks, rare, lexical.question_terms(nobody), 5).top().count() == 0
    assert block_max.BlockSearch(blocks, rare, lexical.question_terms(nobody.filter("qid = 0")), 5).top().count() == 0
    assert block_max.BlockSearch(blocks.filter("false"), rare, _questions(spark, 6), 5).top().count() == 0


def test_more_than_half_is_skipped(spark):
    import __spark_entry__ as entry
    row = entry.queries()["block_max_work"](spark, "/root/testdata/sf0.1").agg(F.sum("blocks").alias("b"), F.sum("scored_blocks").alias("s")).first()
    assert 2 * row.s < row.b
