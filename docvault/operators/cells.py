"""Exact dense search that skips cells of vectors: a centre and a radius bound every inner product inside a cell.

Centres come from a bounded sample; every vector is filed under its nearest centre, with the cell's largest distance and the union of
its access masks. For a question q and a cell with centre c and radius r no vector scores more than q c + |q| r. The best cells are
searched first; their ``n``-th best score is a floor, and cells whose bound is below it are not met. The result is that of
``dense.dense_top`` row for row, whatever the centres. How much is skipped depends on the vectors: clustered ones are skipped for
the most part, while vectors that point evenly in all directions of a space of many dimensions leave no cell out.

Vectors are stored in the order of their cells, so skipped cells are skipped row groups. Questions are taken in blocks of bounded
size; a block's bounds are one product of questions and centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvault.operators.dense import BLOCK_QUESTIONS, Best, matrix, question_blocks, result_type, whole
from docvault.operators.ranking import top_per_question
from docvault.session import _shuffles_go, fresh_path, materialise

SAMPLE = 20_000             # vectors that the centres are fitted on
MOST_CELLS = 1024
ROUNDS = 8
FIRST_CELLS = 4             # cells of each question that are searched for a floor
MOST_BOUNDS = 1 << 22       # questions of a block times cells
SLACK = 2e-6                # scores are rounded to six decimals


@dataclass
class Cells:
    """Vectors with their ``cell``, and of each collection and cell the centre's number, radius and masks."""

    vectors: DataFrame
    centres: np.ndarray
    summary: DataFrame


def fit_centres(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds on the ``sample`` vectors of smallest hash; at most ``MOST_CELLS``."""
    own = vectors.filter(F.col("vec").isNotNull()).select(F.xxhash64("coll", "doc", "n").alias("h"), "vec").orderBy("h").limit(sample).toPandas()
    if not len(own):
        return np.zeros((0, 0))
    x = np.stack(own["vec"].to_numpy()).astype(np.float64)
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(3).permutation(len(centres))[:max(1, min(cells, MOST_CELLS))]]
    for _ in range(rounds):
        near = nearest(x, centres)[0]
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and the distance to it."""
    near = ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return near, np.linalg.norm(x - centres[near], axis=1)


def build_cells(vectors: DataFrame, cells: int) -> Cells:
    """File ``vectors`` (coll, doc, n, mask, superseded, vec) under cells, stored in cell order."""
    rows = vectors.select("coll", "doc", "n", "mask", "superseded", "vec")
    centres = fit_centres(rows, cells)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = ", ".join(f"{k} {v}" for k, v in kind.items()) + ", cell int, distance double"

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near, distance = nearest(np.stack(batch["vec"].to_numpy()).astype(np.float64), centres)
                yield batch.assign(cell=near.astype(np.int32), distance=distance)

    # The key's hash splits a cell that holds a large share of the vectors.
    filed = rows.filter(F.col("vec").isNotNull()).mapInPandas(file, fields)
    filed = materialise(filed, "filed")
    stored = materialise(filed.repartitionByRange("cell", F.xxhash64("coll", "doc", "n")).sortWithinPartitions("cell"), "cells")
    summary = stored.groupBy("coll", "cell").agg(F.max("distance").alias("radius"), F.bit_or("mask").alias("masks"), F.count(F.lit(1)).alias("vectors"))
    return Cells(stored.drop("distance"), centres, materialise(summary, "cell-summary"))


class _CellBest(Best):
    """``Best`` over the cells that are open to a question."""

    def __init__(self, questions: pa.Table, n: int, open_: np.ndarray, floor: np.ndarray):
        super().__init__(questions, n, floor)
        self.open = open_

    def groups(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, (coll, mask, cell) in self._alike(batch, batch.column("cell").to_numpy()):
            asked = self._readers(coll, mask)
            yield rows, asked[self.open[asked, cell]]


def _search(cells: Cells, block: pa.Table, open_: np.ndarray, floor: np.ndarray, n: int, out: str) -> DataFrame:
    """Best ``n`` of each question of a block among its open cells; the ``n``-th best is known to reach ``floor``."""
    spark = cells.vectors.sparkSession
    wanted = np.flatnonzero(open_.any(axis=0)).tolist()
    sent = spark.sparkContext.broadcast((block, open_, floor))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, allowed, least = sent.value
        best = _CellBest(own, n, allowed, least)
        for batch in batches:
            if len(batch):
                best.add(batch)
        yield from best.result()

    some = cells.vectors.filter(F.col("cell").isin(wanted) if wanted else F.lit(False))
    return top_per_question(some.mapInArrow(local, out), "dense", n, ["qid", "coll"])


def pruned_top(cells: Cells, questions: DataFrame, n: int, block: int = BLOCK_QUESTIONS, first_cells: int = FIRST_CELLS) -> tuple[DataFrame, DataFrame]:
    """Top ``n`` per question and collection as ``dense.dense_top`` gives it, and (qid, coll, cells, met_cells).

    ``questions``: (qid, bit, coll, qvec), one row per question and collection.
    """
    spark = questions.sparkSession
    asked = questions.select("qid", "bit", "coll", "qvec")
    out, qid = result_type(asked, cells.vectors), asked.schema["qid"].dataType.simpleString()
    # At most MOST_CELLS rows for the library and each live session.
    summary = cells.summary.filter(F.col("coll").isin([r["coll"] for r in asked.select("coll").distinct().limit(1024).collect()])).toPandas()
    top_path, work_path = fresh_path(spark, "pruned"), fresh_path(spark, "met-cells")
    for rows in question_blocks(asked, min(block, max(1, MOST_BOUNDS // max(1, len(cells.centres))))):
        part = rows.toArrow()
        colls = np.array(part["coll"].to_pylist(), object)
        bound = np.full((len(part), len(cells.centres)), -np.inf)
        if len(part) and len(cells.centres):
            q, bits = matrix(part["qvec"]), whole(part["bit"])
            products, size = q @ cells.centres.T, np.linalg.norm(q, axis=1)
            for coll, own in summary.groupby("coll"):
                of = np.flatnonzero(colls == coll)
                at = own["cell"].to_numpy()
                some = products[np.ix_(of, at)] + size[of, None] * own["radius"].to_numpy()
                bound[np.ix_(of, at)] = np.where((bits[of, None] & own["masks"].to_numpy(np.int64)) != 0, some, -np.inf)
        there = bound > -np.inf
        open_, floor = there, np.full(len(part), -np.inf)
        if bound.shape[1] > first_cells and len(part):
            best = np.argpartition(-bound, first_cells - 1, axis=1)[:, :first_cells]
            first = np.zeros_like(there)
            np.put_along_axis(first, best, True, axis=1)
            tried = _search(cells, part, first & there, floor, n, out)
            with _shuffles_go(spark):
                floors = tried.filter(F.col("rank") == n - 1).select("qid", "coll", "dense").toArrow()  # at most one row a question
            known = dict(zip(zip(floors["qid"].to_pylist(), floors["coll"].to_pylist(), strict=True), floors["dense"].to_pylist(), strict=True))
            floor = np.array([known.get(k, -np.inf) for k in zip(part["qid"].to_pylist(), colls, strict=True)])
            open_ = there & (bound + SLACK >= floor[:, None])
        with _shuffles_go(spark):
            _search(cells, part, open_, floor, n, out).write.mode("append").parquet(top_path)
        work = pd.DataFrame({"qid": part["qid"].to_pandas(), "coll": colls, "cells": there.sum(axis=1), "met_cells": open_.sum(axis=1)})
        spark.createDataFrame(work, f"qid {qid}, coll string, cells long, met_cells long").write.mode("append").parquet(work_path)
    return spark.read.parquet(top_path), spark.read.parquet(work_path)
