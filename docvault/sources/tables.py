"""The supplied Parquet tables in the shapes of this package: a library, questions, an audit trail, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions import pii
from docvault.session import lookup_join, materialise, spread


KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id", "embeddings": "vec_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(found, KEYS[name]) if name in KEYS else found


def _access(source: Column) -> Column:
    """One class of sources is open to all; the others to one role and to executives."""
    number = F.regexp_extract(source, r"(\d+)$", 1).cast("int")
    everyone = F.array(*[F.lit(r) for r in V.ROLES])
    one = F.get(everyone, F.pmod(number, F.lit(7)))
    return F.when(F.pmod(number, F.lit(7)) == 6, everyone).otherwise(F.array_distinct(F.array(one, F.lit("executive"))))


def library_documents(spark: SparkSession, folder: str, with_pii: bool = False) -> DataFrame:
    """``documents`` as a library. Of exact copies, the one with the highest id is current.

    Copies are found by a digest that is counted in each task first; only digests with copies are joined
    back, by broadcast while few and salted beyond, so a text with very many copies never gathers anywhere.
    """
    docs = table(spark, folder, "documents").withColumn("digest", F.sha2("text", 256))
    groups = docs.groupBy("digest").agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("c"))
    copies = materialise(groups.filter("c > 1").select("digest", "newest"), "copies")
    docs = lookup_join(docs, copies, ["digest"], "left", salt=F.xxhash64("doc_id"))
    status = F.when(F.col("newest") > F.col("doc_id"), "superseded").otherwise("current")
    found = pii.counts(pii.spans("text")) if with_pii else F.lit(None).cast("map<string,int>")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.lit("").alias("title_ar"),
        _access(F.col("source")).alias("access"), F.lit("Internal").alias("classification"), F.col("source").alias("owner"),
        "lang", "text", F.lit(False).alias("uploaded"), found.alias("pii"), status.alias("status"),
        F.lit("").alias("superseded_by"), F.lit("library").alias("coll"))


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` passages as questions (qid, q, role); roles take turns."""
    roles = F.array(*[F.lit(r) for r in V.ROLES])
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("q"), roles[F.pmod("item_id", F.lit(6)).cast("int")].alias("role"))


def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as an audit trail: purchases are uploads, everything else questions."""
    whole = F.floor("value").cast("int")
    return table(spark, folder, "events").select(
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"),
        F.concat(F.lit("session"), "user_id").alias("session"), F.lit("employee").alias("role"),
        F.when(F.col("event_type") == "purchase", "upload").otherwise("ask").alias("kind"),
        F.col("props").alias("question"), F.col("event_type").alias("docs"),
        (F.col("event_type") == "error").cast("int").alias("refused"), F.pmod(whole, F.lit(3)).alias("masked"),
        F.when(whole > 20, 1).otherwise(0).alias("injections"), whole.alias("ms"))


def request_log(events: DataFrame) -> DataFrame:
    """``events`` as requests: purchases and sign-ups write, the rest reads."""
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("client"),
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.col("ts").cast("timestamp").alias("ts"))


def upload_log(events: DataFrame) -> DataFrame:
    """Purchases as uploads of a session."""
    return events.filter("event_type = 'purchase'").select(
        "event_id", F.concat(F.lit("session"), "user_id").alias("sid"),
        F.concat(F.lit("up_"), "event_id").alias("id"), F.col("ts").cast("timestamp").alias("created"))


def deletion_log(events: DataFrame) -> DataFrame:
    """Sign-ups as deletions of the file uploaded by the event named in ``props``, by that session."""
    return events.filter("event_type = 'signup'").select(
        F.concat(F.lit("session"), "user_id").alias("sid"),
        F.concat(F.lit("up_"), F.get_json_object("props", "$.k")).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
