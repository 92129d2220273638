"""Merged sketches against exact ranks."""

import numpy as np
from pyspark.sql import functions as F

from docvault.operators import sketches


def test_rank_error_of_merged_windows(spark):
    draw = np.random.default_rng(4)
    values = draw.lognormal(3, 1, 20_000)
    rows = spark.createDataFrame([(k % 3, 1_700_000_000 + 7 * k, float(v)) for k, v in enumerate(values)], "tenant int, s long, ms double").withColumn("ts", F.timestamp_seconds("s"))
    rows = rows.unionByName(rows.limit(1).withColumn("ms", F.lit(None).cast("double"))).repartition(5)
    stored = sketches.window_sketches(rows, "ts", "ms", by=["tenant"]).cache()
    assert stored.count() > 100 and stored.agg(F.sum("n")).first()[0] == 20_000
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for found, own in [(sketches.percentiles(sketches.merged(stored), shares).first(), values)] + [
            (r, values[r.tenant::3]) for r in sketches.percentiles(sketches.merged(stored, ["tenant"]), shares, ["tenant"]).collect()]:
        assert found.n == len(own)
        for name, share in shares.items():
            assert abs((own <= found[name]).mean() - share) <= 2 * sketches.RANK_ERROR
    half = F.timestamp_seconds(F.lit(1_700_000_000 + 70_000))
    parts = [sketches.merged(stored, low=a, high=b).first().n for a, b in ((None, half), (half, None))]
    assert sum(parts) == 20_000 and min(parts) > 0


def test_no_values(spark):
    rows = spark.createDataFrame([], "ts timestamp, ms double")
    assert sketches.merged(sketches.window_sketches(rows, "ts", "ms")).count() == 0
