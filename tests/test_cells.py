"""Cell-pruned dense search against the plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docvault.operators import cells, dense


def _vectors(spark, x, colls=("library",), seed=0):
    draw = np.random.default_rng(seed)
    rows = [(str(draw.choice(list(colls))), f"d{k // 2}", k % 2, int(draw.choice([0, 1, 2, 3, 7])), bool(draw.random() < 0.3), [float(v) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "coll string, doc string, n int, mask int, superseded boolean, vec array<float>").repartition(4)


def _questions(spark, x, colls=("library",)):
    rows = [(k, 1 << (k % 3), c, [float(v) for v in r]) for k, r in enumerate(x) for c in colls]
    return spark.createDataFrame(rows, "qid long, bit int, coll string, qvec array<float>")


SHOWN = ["qid", "coll", "doc", "n", "superseded", "dense", "rank"]


@pytest.mark.parametrize("spread,block", [(0.05, 4096), (3.0, 7)])
def test_same_rows_as_plain_search(spark, spread, block):
    draw = np.random.default_rng(int(10 * spread))
    centres = draw.normal(0, 1, (12, 16))
    x = centres[draw.integers(0, 12, 900)] + spread * draw.normal(0, 1, (900, 16))
    x[5] = x[6] = x[7]                                   # ties
    vectors = _vectors(spark, x, ("library", "s1"))
    questions = _questions(spark, np.concatenate([x[:30], np.zeros((1, 16))]), ("library", "s1", "s2"))
    found, work = cells.pruned_top(cells.build_cells(vectors, 24), questions, 5, block)
    want = {tuple(r) for r in dense.dense_top(vectors, questions, 5).select(*SHOWN).collect()}
    assert {tuple(r) for r in found.select(*SHOWN).collect()} == want and len(want) > 200
    done = work.filter("coll = 'library'").agg(F.sum("cells").alias("c"), F.sum("met_cells").alias("m")).first()
    assert done.m <= done.c and (spread > 1 or 2 * done.m < done.c)  # clustered vectors are skipped for the most part


def test_few_and_no_vectors(spark):
    x = np.eye(3)
    for vectors in (_vectors(spark, x), _vectors(spark, x).filter("false"), _vectors(spark, x).withColumn("vec", F.when(F.col("doc") == "d0", F.col("vec")))):
        found, work = cells.pruned_top(cells.build_cells(vectors, 8), _questions(spark, x), 5)
        want = {tuple(r) for r in dense.dense_top(vectors.filter("vec is not null"), _questions(spark, x), 5).select(*SHOWN).collect()}
        assert {tuple(r) for r in found.select(*SHOWN).collect()} == want
    found, work = cells.pruned_top(cells.build_cells(_vectors(spark, x), 2), _questions(spark, x).filter("false"), 5)
    assert found.count() == 0 and work.count() == 0
