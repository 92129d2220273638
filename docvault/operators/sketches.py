"""Latency percentiles from mergeable sketches: one KLL sketch per window, merged for any span.

A window's sketch has a few hundred numbers whatever the number of requests, so a day, a week or a tenant is answered from stored
sketches without reading requests again. A percentile's rank is off by at most ``RANK_ERROR``, with a probability of 99 percent; the
exact form is ``evaluation.latency_percentiles``. Null values and times are left out; a span without values has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK_ERROR = 0.0133         # normalised rank error of a sketch with k = 200, the default


def window_sketches(rows: DataFrame, ts: str, value: str, window: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """(by, start, n, sketch) of every window that has values."""
    own = rows.select(*(by or []), F.col(ts).cast("timestamp").alias("_ts"), F.col(value).cast("double").alias("_v")).filter("_ts is not null and _v is not null")
    grouped = own.groupBy(*(by or []), F.window("_ts", window)["start"].alias("start"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v").alias("sketch"))


def merged(sketches: DataFrame, by: list[str] | None = None, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(by, n, sketch) of all windows from ``low`` to before ``high``."""
    if low is not None:
        sketches = sketches.filter(F.col("start") >= low)
    if high is not None:
        sketches = sketches.filter(F.col("start") < high)
    found = sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return found.filter("n > 0")


def percentiles(sketches: DataFrame, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, n, one column per share) of merged sketches."""
    return sketches.select(*(by or []), "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias(name) for name, share in shares.items()])
