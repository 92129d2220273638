"""Role permissions: who may read which document, the library listing and the document reader.

A document's access list is an allow-list without hierarchy. Inside search tables it is carried as one
integer with a bit per role, so the check stays a code-generated integer test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions import pii
from docvault.functions.injection import flagged_lines
from docvault.functions.text import word_count


def access_mask(access: Column) -> Column:
    bits = [F.when(F.array_contains(access, role), F.lit(1 << i)).otherwise(F.lit(0)) for i, role in enumerate(V.ROLES)]
    return F.coalesce(reduce(lambda a, b: a + b, bits), F.lit(0))


def role_bit(role: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(V.ROLES):
        out = F.when(role == name, F.lit(1 << i)).otherwise(out)
    return out


def allows(mask: Column, bit: Column) -> Column:
    return mask.bitwiseAND(bit) != 0


def permitted(documents: DataFrame, role: str) -> DataFrame:
    return documents.filter(F.array_contains("access", role))


def denied(documents: DataFrame, role: str) -> DataFrame:
    return documents.filter(~F.array_contains("access", role))


def documents_per_role(documents: DataFrame) -> DataFrame:
    opened = documents.select(F.explode("access").alias("role"))
    return opened.groupBy("role").agg(F.count(F.lit(1)).alias("documents"))


def listing(documents: DataFrame, role: str, uploads: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Every document with whether ``role`` may read it; a session's live uploads follow."""
    shown = ["id", "title", "title_ar", "classification", "owner", "lang", "access"]
    library = documents.select(
        *shown, F.array_contains("access", role).alias("can_read"), "status", "pii", F.lit(False).alias("uploaded"),
        word_count(F.col("text")).alias("words"), F.lit(None).cast("int").alias("expires_in_min"))
    if uploads is None:
        return library
    age = (F.unix_timestamp(now) - F.unix_timestamp("created")) / 60
    left = F.greatest(F.lit(0), F.bround(F.lit(V.UPLOAD_TTL_MIN) - age).cast("int"))
    mine = uploads.select(
        *shown, F.lit(True).alias("can_read"), "status", "pii", F.lit(True).alias("uploaded"),
        word_count(F.col("text")).alias("words"), left.alias("expires_in_min"))
    return library.unionByName(mine)


def read_documents(documents: DataFrame, requests: DataFrame, contact_docs: list[str] = V.CONTACT_DOCS) -> DataFrame:
    """Whole documents as the requesting role may see them, for rows of (doc_id, role, sid).

    A document that does not exist, is locked for the role or belongs to another session gives no row.
    """
    mine = (F.col("uploaded") & (F.col("coll") == F.col("sid"))) | (
        ~F.col("uploaded") & F.array_contains("access", F.col("role")))
    found = documents.join(requests, documents["id"] == requests["doc_id"]).filter(mine)
    found = found.withColumn("hide", pii.hidden_spans(
        pii.spans("text"), pii.may_see_contacts(F.col("role"), F.col("id").isin(contact_docs))))
    return found.select(
        "doc_id", "role", "sid", "title", "title_ar", "classification", "owner", "lang", "status", "superseded_by",
        pii.mask(F.col("text"), F.col("hide")).alias("text"), pii.counts(F.col("hide")).alias("masked"),
    ).withColumn("injection_lines", flagged_lines(F.col("text")))
