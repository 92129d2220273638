"""Document libraries: Markdown files with a small header, question sets, and the table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions import pii
from docvault.functions.text import lines, strip

DOCUMENT_SCHEMA = ("id STRING, title STRING, title_ar STRING, access ARRAY<STRING>, classification STRING, owner STRING, "
                   "lang STRING, text STRING, uploaded BOOLEAN, pii MAP<STRING, INT>, status STRING, "
                   "superseded_by STRING, coll STRING")
QUESTION_SCHEMA = ("id STRING, type STRING, lang STRING, role STRING, doc STRING, q STRING, expect ARRAY<STRING>, "
                   "must_not ARRAY<STRING>")
LIBRARY = "library"
_HEADER = r"(?s)\A---\n(.*?)\n---\n"


def _header_value(header_lines: Column, key: str) -> Column:
    """Value of the last header line with this key; the first colon ends the key."""
    mine = F.filter(header_lines, lambda x: x.contains(":") & (strip(F.substring_index(x, ":", 1)) == key))
    return strip(F.regexp_replace(F.get(mine, F.size(mine) - 1), r"\A[^:]*:", ""))


def parse_documents(raw: DataFrame) -> DataFrame:
    """Documents from rows of (name, content), where content is a whole file."""
    body = raw.select("name", F.regexp_replace("content", r"\r\n?", "\n").alias("content"))
    body = body.select(
        "name",
        lines(F.regexp_extract("content", _HEADER, 1)).alias("header"),
        F.regexp_replace("content", _HEADER, "").alias("body"),
    )

    def value(key: str, default: Column) -> Column:
        return F.coalesce(_header_value(F.col("header"), key), default)

    access = _header_value(F.col("header"), "access")
    # only a bracketed list of known roles opens a document; anything else opens it to nobody
    listed = F.when(access.rlike(r"^\[.*\]$"), F.transform(F.split(F.regexp_replace(access, r"^\[|\]$", ""), ","), strip))
    known = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda r: r.isin(V.ROLES))
    found = body.select(
        value("id", F.raise_error(F.concat(F.lit("document without id: "), F.col("name")))).alias("id"),
        value("title", F.regexp_replace("name", r"\.[^.]*$", "")).alias("title"),
        value("title_ar", F.lit("")).alias("title_ar"),
        known.alias("access"),
        value("classification", F.lit("Internal")).alias("classification"),
        value("owner", F.lit("")).alias("owner"),
        value("lang", F.lit("en")).alias("lang"),
        strip(F.col("body")).alias("text"),
        F.lit(False).alias("uploaded"),
        pii.spans("body").alias("found"),
        value("status", F.lit("current")).alias("status"),
        value("superseded_by", F.lit("")).alias("superseded_by"),
        F.lit(LIBRARY).alias("coll"),
    )
    return found.withColumn("found", pii.counts(F.col("found"))).withColumnRenamed("found", "pii")


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """All Markdown files of a folder as documents."""
    raw = (spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
           .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")))
    return parse_documents(raw)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set, one JSON object per line."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)
