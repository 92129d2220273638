"""Extractive answers: refusal rules, sentence scores, and the pick of one or two sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.text import numbers, pairs, sentences, tokens
from docvault.operators.evidence import coverage, support


def refusal_text(lang: Column) -> Column:
    return F.when(lang == "ar", V.REFUSAL["ar"]).otherwise(V.REFUSAL["en"])


def supported_sources(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sources of (qid, rank, doc, title, section, text, superseded, ...) with the question's profile and support."""
    both = sources.join(profiles, "qid")
    tokenised = both.withColumns({
        "title_tokens": tokens("title"), "section_tokens": tokens("section"),
        "text_tokens": tokens("text")})
    have = F.concat("title_tokens", "section_tokens", "text_tokens")
    return tokenised.withColumn("support", F.round(support(F.col("terms"), F.col("key_variants"), have), 9))


def gates(profiles: DataFrame, supported: DataFrame) -> DataFrame:
    """(qid, lang, best, note, refuse): whether a question is refused before sentences are looked at."""
    best = supported.groupBy("qid").agg(F.max("support").alias("best"))
    both = profiles.select("qid", "lang", F.size("unknown").alias("unknown")).join(best, "qid", "left")
    both = both.withColumn("best", F.coalesce("best", F.lit(0.0)))
    missing = ((F.col("unknown") >= 2) & (F.col("best") < V.UNKNOWN_TERMS_SUPPORT)) | ((F.col("unknown") == 1) & (F.col("best") < V.UNKNOWN_TERM_SUPPORT))
    return both.select("qid", "lang", "best", F.when(missing, "unknown_term").alias("note"),
                       (missing | (F.col("best") < V.MIN_SUPPORT)).alias("refuse"))


def sentence_scores(supported: DataFrame) -> DataFrame:
    """(qid, rank, pos, sentence, doc, superseded, support, score) of sentences that mention a key term."""
    good = supported.filter(F.col("support") >= V.MIN_SUPPORT)
    rows = good.select("*", F.posexplode(sentences("text")).alias("pos", "sentence")).withColumn(
        "sent_tokens", tokens("sentence"))
    mentioned = F.concat("title_tokens", "section_tokens", "sent_tokens")
    rows = rows.filter((F.size("key_variants") == 0) | F.arrays_overlap("key_variants", mentioned))
    shared = F.least(F.size(F.array_intersect("pairs", pairs(F.col("sent_tokens")))), F.lit(V.MOST_PAIRS))
    has_number = F.col("wants_number") & (F.size(numbers(F.col("sentence"))) > 0)
    score = (V.SECTION_WEIGHT * coverage(F.col("terms"), F.concat("section_tokens", "sent_tokens"))
             + V.SENTENCE_WEIGHT * coverage(F.col("terms"), F.col("sent_tokens"))
             + V.SOURCE_WEIGHT * F.col("support") - V.RANK_WEIGHT * F.col("rank") + V.PAIR_WEIGHT * shared
             - F.when(F.col("superseded"), V.SUPERSEDED_WEIGHT).otherwise(0.0) + F.when(has_number, V.NUMBER_WEIGHT).otherwise(0.0))
    return rows.select("qid", "rank", "pos", "sentence", "doc", "superseded", "support", F.round(score, 9).alias("score"))


def pick_sentences(scored: DataFrame) -> DataFrame:
    """(qid, picked, citation, support, superseded): the best sentence, with a nearly equal neighbour if any."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "pos")
    first = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= V.QUOTED_FROM)
    listed = first.groupBy("qid").agg(F.array_sort(F.collect_list(
        F.struct("place", "rank", "pos", "score", "sentence", "support", "superseded"))).alias("c"))
    listed = listed.withColumn("top", F.col("c")[0])
    near = F.filter("c", lambda x: (x["place"] > 1) & (x["rank"] == F.col("top.rank"))
                    & (F.abs(x["pos"] - F.col("top.pos")) == 1) & (x["score"] >= V.NEIGHBOUR_SHARE * F.col("top.score")))
    both = F.concat(F.array("top"), F.slice(near, 1, 1))
    in_order = F.array_sort(F.transform(both, lambda x: F.struct(x["pos"], F.rtrim(x["sentence"]).alias("sentence"))))
    return listed.select("qid", F.array_join(F.transform(in_order, lambda x: x["sentence"]), " ").alias("picked"),
                         (F.col("top.rank") + 1).alias("citation"), "top.support", "top.superseded")


def extractive_answers(profiles: DataFrame, supported: DataFrame) -> DataFrame:
    """(qid, text, refused, citations, method, support, notes), one row per question."""
    gate = gates(profiles, supported)
    passed = supported.join(gate.filter(~F.col("refuse")).select("qid"), "qid", "left_semi")
    picked = pick_sentences(sentence_scores(passed))
    rows = gate.join(picked, "qid", "left")
    answered = F.col("picked").isNotNull()
    ended = F.when(F.col("picked").rlike(r"[.؟?!]\z"), F.col("picked")).otherwise(F.concat("picked", F.lit(".")))
    none = F.array().cast("array<string>")
    return rows.select(
        "qid",
        F.when(answered, F.format_string("%s [%d]", ended, F.col("citation"))).otherwise(refusal_text(F.col("lang"))).alias("text"),
        (~answered).alias("refused"),
        F.when(answered, F.array("citation")).otherwise(F.array().cast("array<int>")).alias("citations"),
        F.lit("extractive").alias("method"),
        F.when(answered, F.col("support")).when(F.col("refuse"), F.col("best")).otherwise(0.0).alias("support"),
        F.when(answered & F.col("superseded"), F.array(F.lit("superseded_source")))
        .when(F.col("note").isNotNull(), F.array("note")).otherwise(none).alias("notes"))
