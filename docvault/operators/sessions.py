"""Session uploads: the cap on live files, expiry, deletion, and the most recently used sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.operators.limits import admit

TTL_SECONDS = V.UPLOAD_TTL_MIN * 60


def active_sessions(touches: DataFrame, cap: int = V.MAX_SESSIONS) -> DataFrame:
    """(sid, touched): the ``cap`` sessions used last."""
    last = touches.groupBy("sid").agg(F.max("ts").alias("touched"))
    return last.orderBy(F.desc("touched"), "sid").limit(cap)


def accepted_uploads(uploads: DataFrame, deletions: DataFrame | None = None, cap: int = V.MAX_UPLOADS_PER_SESSION,
                     ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Uploads (event_id, sid, id, created, ...) with ``admitted``: at most ``cap`` live files per session.

    Only the owning session can delete a file; a deleted or expired file makes room.
    """
    if deletions is None:
        return admit(uploads, ["sid"], "created", F.lit(cap), ttl_seconds)
    gone = deletions.groupBy("sid", "id").agg(F.min("ts").alias("deleted_at"))
    marked = uploads.join(gone, ["sid", "id"], "left")
    return admit(marked, ["sid"], "created", F.lit(cap), ttl_seconds, F.col("deleted_at"))


def live_uploads(uploads: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Files not older than the time to live, counted from creation, with minutes left."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))
    left = F.greatest(F.lit(0), F.bround((ttl_seconds - age / 1_000_000) / 60).cast("int"))
    return uploads.filter(age.between(0, ttl_seconds * 1_000_000)).withColumn("expires_in_min", left)


def without_deleted(uploads: DataFrame, deletions: DataFrame) -> DataFrame:
    """Uploads minus deletions (sid, id) by the owning session."""
    return uploads.join(deletions.select("sid", "id").distinct(), ["sid", "id"], "left_anti")


def deletion_results(uploads: DataFrame, deletions: DataFrame) -> DataFrame:
    """(sid, id, deleted): whether each request named a file of its own session."""
    mine = uploads.select("sid", "id").distinct().withColumn("deleted", F.lit(True))
    return deletions.join(mine, ["sid", "id"], "left").select("sid", "id", F.coalesce("deleted", F.lit(False)).alias("deleted"))
