"""The response to a question: masked answer and sources, counts, and the audit row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions import pii
from docvault.sources.audit import audit_row


def _total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda acc, n: acc + n)


def responses(profiles: DataFrame, sources: DataFrame, answers: DataFrame,
              contact_docs: list[str] = V.CONTACT_DOCS) -> DataFrame:
    """One row per question with everything shown to the user; nothing unmasked leaves this step.

    ``sources``: (qid, rank, doc, title, section, text, superseded, classification, uploaded, injection_removed).
    """
    asked = profiles.select("qid", "q", "role", "sid", "lang")
    given = answers.select("qid", "citations")
    shown = sources.join(asked.select("qid", "role"), "qid").join(given, "qid")
    contact = F.col("doc").isin(contact_docs)
    shown = shown.withColumns({
        "n": F.col("rank") + 1, "cited": F.array_contains("citations", F.col("rank") + 1),
        "hide": pii.hidden_spans(pii.spans("text"), pii.may_see_contacts(F.col("role"), contact))})
    shown = shown.withColumns({"safe": pii.mask(F.col("text"), F.col("hide")), "masked": pii.counts(F.col("hide"))})
    source = F.struct("n", "doc", "title", "section", F.col("safe").alias("text"), "cited", "superseded",
                      "classification", "uploaded", "injection_removed", "masked")
    listed = shown.groupBy("qid").agg(
        F.array_sort(F.collect_list(source), lambda a, b: a["n"] - b["n"]).alias("sources"),
        F.sum("injection_removed").cast("int").alias("injections_blocked"),
        F.sum(F.when(F.col("cited"), _total(F.col("masked"))).otherwise(0)).cast("int").alias("masked_in_sources"),
        F.array_sort(F.collect_set(F.when(F.col("cited"), F.col("doc")))).alias("cited_docs"))
    rows = asked.join(answers, "qid").join(listed, "qid", "left")
    docs = F.coalesce("cited_docs", F.array().cast("array<string>"))
    only_contacts = (F.size(docs) > 0) & (F.size(F.array_except(docs, F.array(*[F.lit(d) for d in contact_docs]))) == 0)
    rows = rows.withColumn("hide", pii.hidden_spans(
        pii.spans("text"), pii.may_see_contacts(F.col("role"), only_contacts)))
    return rows.select(
        "qid", F.col("q").alias("question"), "role", "sid", "lang",
        pii.mask(F.col("text"), F.col("hide")).alias("answer"), "refused", "citations", "method",
        F.round("support", 3).alias("support"), "notes", pii.counts(F.col("hide")).alias("masked"),
        F.coalesce("injections_blocked", F.lit(0)).alias("injections_blocked"), "sources", docs.alias("cited_docs"),
        (_total(pii.counts(F.col("hide"))) + F.coalesce("masked_in_sources", F.lit(0))).alias("total_masked"))


def audit_rows(answered: DataFrame, ts: Column, ms: Column, seq: Column, redact: bool = False) -> DataFrame:
    """Audit rows of answered questions; ``seq`` orders them within the trail."""
    return answered.select(*audit_row(
        ts, seq, F.col("sid"), F.col("role"), F.lit("ask"), F.col("question"),
        F.col("cited_docs"), F.col("refused"), F.col("total_masked"), F.col("injections_blocked"), ms, redact))


def events(answered: DataFrame) -> DataFrame:
    """(qid, seq, event) rows as an event stream would carry them: sources first, then the final answer."""
    preview = F.to_json(F.struct(F.lit("sources").alias("type"), F.transform(
        "sources", lambda s: F.struct(s["n"].alias("n"), s["title"].alias("title"), s["section"].alias("section"))).alias("sources")))
    final = F.to_json(F.struct(F.lit("final").alias("type"), "question", "role", "lang", "answer", "refused", "citations",
                               "method", "support", "notes", "masked", "injections_blocked", "sources"))
    return answered.select("qid", F.posexplode(F.array(preview, final)).alias("seq", "event"))
