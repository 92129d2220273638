"""Audit trail: an append-only Parquet table, one folder per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvault.functions import pii

AUDIT_SCHEMA = ("ts TIMESTAMP, seq BIGINT, session STRING, role STRING, kind STRING, question STRING, docs STRING, "
                "refused INT, masked INT, injections INT, ms INT")
SHOWN = ["ts", "role", "kind", "question", "docs", "refused", "masked", "injections", "ms"]


def audit_row(ts: Column, seq: Column, session: Column, role: Column, kind: Column, question: Column, docs: Column,
              refused: Column, masked: Column, injections: Column, ms: Column, redact: bool = False) -> list[Column]:
    """Columns of one audit row. Times keep whole seconds; ``redact=True`` masks identifiers in the question."""
    asked = pii.mask(question, pii.spans(question)) if redact else question
    return [F.date_trunc("second", ts).alias("ts"), seq.cast("bigint").alias("seq"),
            F.coalesce(session, F.lit("-")).alias("session"), role.alias("role"), kind.alias("kind"),
            F.substring(asked, 1, 500).alias("question"), F.array_join(docs, ",").alias("docs"),
            refused.cast("int").alias("refused"), masked.cast("int").alias("masked"),
            injections.cast("int").alias("injections"), ms.cast("int").alias("ms")]


def upload_rows(uploads: DataFrame, seq: Column, ms: Column) -> DataFrame:
    """Audit rows of accepted uploads, as ``upload_documents`` gives them: the file's name, its id and its identifiers."""
    found = F.aggregate(F.map_values(F.coalesce("pii", F.create_map().cast("map<string,int>"))), F.lit(0), lambda a, n: a + n)
    return uploads.select(*audit_row(
        F.col("created"), seq, F.col("coll"), F.lit("-"), F.lit("upload"), F.col("title"), F.array("id"), F.lit(False), found, F.lit(0), ms))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{AUDIT_SCHEMA}, day DATE").parquet(path)


def last_events(audit: DataFrame, session: str, limit: int = 50) -> DataFrame:
    """The session's latest rows, newest first."""
    mine = audit.filter(F.col("session") == session)
    return mine.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).select(*SHOWN)


def totals(audit: DataFrame) -> DataFrame:
    """Questions, refusals, masked items and removed instructions over all questions asked."""
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return audit.filter(F.col("kind") == "ask").agg(
        F.count(F.lit(1)).alias("questions"), total("refused").alias("refused"),
        total("masked").alias("masked"), total("injections").alias("injections_blocked"))


def ledger(audit: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Overall totals, and the session's last 20 events."""
    return totals(audit), last_events(audit, session, 20)
