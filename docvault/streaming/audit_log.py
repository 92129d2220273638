"""Audit ingestion and streamed questions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docvault.plans.ask import ask
from docvault.plans.library import Library
from docvault.operators.responses import audit_rows
from docvault.session import intermediates
from docvault.sources.audit import AUDIT_SCHEMA

# Audit rows of batch b are numbered from b * BATCH_ROWS on, in order of arrival.
BATCH_ROWS = 1 << 32


def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows that arrive as JSON files."""
    return spark.readStream.schema(AUDIT_SCHEMA).json(folder)


def _trigger(every: str | None) -> dict:
    """All that is there, then stop; or a batch every so often, as "10 seconds"."""
    return {"availableNow": True} if every is None else {"processingTime": every}


def store_audit(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to the audit table, partitioned by day; the file sink commits each batch once."""
    dated = rows.withColumn("day", F.to_date("ts"))
    return (dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("day").outputMode("append").trigger(**_trigger(every)).start())


def running_totals(rows: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Totals of questions per hour of event time."""
    asked = rows.filter("kind = 'ask'").withWatermark("ts", delay)
    return asked.groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("questions"), F.sum("refused").alias("refused"), F.sum("masked").alias("masked"),
        F.sum("injections").alias("injections_blocked"))


def answer_stream(library: Library, questions: DataFrame, answers_path: str, audit_path: str, checkpoint: str,
                  every: str | None = None, **options) -> StreamingQuery:
    """Answer a stream of (qid, q, role, ts) in micro-batches; responses and audit rows are appended.

    Each batch writes to a folder of its own number, so a batch that runs again replaces itself, and removes what it
    materialised. ``ms`` is the time its batch took; ``seq`` follows batches, then time and question.
    """
    def answer(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark, began = batch.sparkSession, time.monotonic()
        with intermediates(spark):
            ask(library, batch.drop("ts"), **options).write.mode("overwrite").parquet(f"{answers_path}/batch={number}")
        stored = spark.read.parquet(f"{answers_path}/batch={number}").join(batch.select("qid", "ts"), "qid")
        # One micro-batch of questions is numbered in one task; its size is bounded by the source's options.
        seq = F.row_number().over(Window.orderBy("ts", "qid")) + F.lit(number * BATCH_ROWS)
        log = audit_rows(stored, F.col("ts"), F.lit(int((time.monotonic() - began) * 1000)), seq)
        log.write.mode("overwrite").parquet(f"{audit_path}/batch={number}")

    return (questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
            .trigger(**_trigger(every)).start())
