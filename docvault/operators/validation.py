"""Input checks of requests: one row in, the first reason for refusal out (null when valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.text import strip


def bad_role(role: Column) -> Column:
    return ~F.coalesce(role, F.lit("employee")).rlike(V.ROLE_PATTERN)


def bad_session(sid: Column) -> Column:
    return sid.isNotNull() & ~sid.rlike(V.SESSION_PATTERN)


def check_questions(requests: DataFrame) -> DataFrame:
    """Trimmed questions of (q, role, sid) with ``error``: 2 to 400 characters, a known role, a well-formed session."""
    rows = requests.withColumn("q", strip(F.col("q"))).withColumn("role", F.coalesce("role", F.lit("employee")))
    error = (F.when(~F.length("q").between(2, 400) | F.col("q").isNull(), "question must be 2-400 characters")
             .when(bad_role(F.col("role")), "invalid role").when(bad_session(F.col("sid")), "invalid session id"))
    return rows.withColumn("error", error)


def check_scans(requests: DataFrame) -> DataFrame:
    error = (F.when(~F.coalesce(F.length("text"), F.lit(0)).between(1, 5000), "text must be 1-5000 characters")
             .when(bad_role(F.col("role")), "invalid role"))
    return requests.withColumn("error", error)


def check_reads(requests: DataFrame) -> DataFrame:
    error = (F.when(~F.coalesce(F.col("doc_id").rlike(V.DOC_ID_PATTERN), F.lit(False)), "invalid document id")
             .when(bad_role(F.col("role")), "invalid role").when(bad_session(F.col("sid")), "invalid session id"))
    return requests.withColumn("error", error)


def check_deletions(requests: DataFrame) -> DataFrame:
    ok = F.col("id").rlike(V.UPLOAD_ID_PATTERN) & F.col("sid").rlike(V.SESSION_PATTERN)
    return requests.withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), "upload not found"))
