"""Scan preview: masking of any text, with nothing stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvault.functions import pii


def scan(texts: DataFrame) -> DataFrame:
    """Rows of (text, role, ...) with ``masked`` text and ``found`` counts. Contacts of a loose text are never shown."""
    rows = texts.withColumn("_hide", pii.hidden_spans(pii.spans("text"), F.lit(False)))
    return rows.withColumns({"masked": pii.mask(F.col("text"), F.col("_hide")),
                             "found": pii.counts(F.col("_hide"))}).drop("_hide")
