"""What a question asks for, and how well a passage supports answering it.

A question profile is one row per question with its weighted terms, built from the vocabulary its role may
see. With the profile at hand every check on a passage or sentence is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.common import empty_array
from docvault.functions.text import is_arabic, is_digits, pairs, tokens
from docvault.operators import glossary
from docvault.operators.access import access_mask, allows, role_bit
from docvault.operators.lexical import collection_stats, idf, only_terms

TERM = "STRUCT<pos: INT, term: STRING, weight: DOUBLE, rarity: DOUBLE, known: BOOLEAN, variants: ARRAY<STRING>>"


def vocabulary(index: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(coll, term, idf, mask): every indexed term, its rarity, and a bit per role that may see it.

    Rarity is that of the whole collection. A term is visible through a permitted passage, or through a
    permitted document's title when the term is indexed at all.
    """
    terms = index.select("coll", "mask", F.explode(F.array_distinct("tokens")).alias("term"), F.lit(1).alias("in_passage"))
    if documents is not None:
        titles = documents.select("coll", access_mask(F.col("access")).alias("mask"),
                                  F.explode(tokens("title")).alias("term"), F.lit(0).alias("in_passage"))
        terms = terms.unionByName(titles)
    seen = terms.groupBy("coll", "term").agg(F.sum("in_passage").alias("df"), F.bit_or("mask").alias("mask"))
    stats = F.broadcast(collection_stats(index))  # the library and a capped number of sessions
    return seen.filter("df > 0").join(stats, "coll").select(
        "coll", "term", idf(F.col("passages"), F.col("df")).alias("idf"), "mask")


def role_vocabulary(vocab: DataFrame) -> DataFrame:
    """(role, terms, max_idf) of each role over the library vocabulary."""
    roles = F.filter(F.array(*[F.when(allows(F.col("mask"), F.lit(1 << i)), F.lit(r)) for i, r in enumerate(V.ROLES)]),
                     lambda r: r.isNotNull())
    return vocab.select("idf", F.explode(roles).alias("role")).groupBy("role").agg(
        F.count(F.lit(1)).alias("terms"), F.max("idf").alias("max_idf"))


def _rarest_seen(vocab: DataFrame, sessions: bool) -> DataFrame:
    """(coll, one column per role): the greatest rarity a role can see in the library, and in each session.

    A session's term that the role already sees in the library counts with the library's rarity.
    """
    library = vocab.filter("coll = 'library'").withColumn("seen", F.col("mask"))
    if sessions:
        known = library.select("term", F.col("mask").alias("lib_mask"))
        mine = vocab.filter("coll <> 'library'").join(known, "term", "left")
        unseen = F.coalesce(F.bitwise_not("lib_mask"), F.lit(-1))
        library = library.unionByName(mine.withColumn("seen", unseen).select(library.columns))
    per_role = [F.max(F.when(allows(F.col("seen"), F.lit(1 << i)), F.col("idf"))).alias(r) for i, r in enumerate(V.ROLES)]
    return library.groupBy("coll").agg(*per_role)


def question_profiles(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, q, lang, role, sid, terms, unknown, keys, key_variants, pairs, wants_number).

    ``terms`` are the question's distinct tokens with weight min(6, rarity); a token the role cannot see
    weighs as the rarest one it can. A session's own vocabulary fills in behind the role's.
    """
    has_sid = "sid" in questions.columns
    base = questions.select(
        "qid", "q", "role", (F.col("sid") if has_sid else F.lit(None).cast("string")).alias("sid"),
        tokens("q").alias("own"))
    listed = F.array_distinct("own")
    rows = base.select(
        "qid", "role", "sid",
        F.posexplode(F.filter(listed, lambda t: ~is_digits(t))).alias("pos", "term")
    ).withColumn("variants", glossary.variants("term"))
    wanted = rows.select("qid", "role", "sid", "pos", F.col("term").alias("own_term"), F.explode("variants").alias("term"))
    wanted = wanted.withColumn("coll", F.explode(F.array_compact(F.array(F.lit("library"), "sid"))))
    terms = wanted.select("coll", "term").distinct()
    # only terms some question asks for leave the vocabulary
    found = wanted.join(only_terms(vocab, terms), ["coll", "term"])
    found = found.filter((F.col("coll") != "library") | allows(F.col("mask"), role_bit(F.col("role"))))
    in_library = F.col("coll") == "library"

    def first_of(value: Column) -> Column:
        return F.coalesce(F.max(F.when(in_library, value)), F.max(value))

    per_variant = found.groupBy("qid", "pos", "own_term", "term").agg(first_of(F.col("idf")).alias("idf"))
    per_term = per_variant.groupBy("qid", "pos").agg(
        F.max("idf").alias("rarity"), F.max(F.when(F.col("term") == F.col("own_term"), F.col("idf"))).alias("own_idf"))
    # one row for the library and one per live session, a capped number
    by_role = F.create_map(*[x for r in V.ROLES for x in (F.lit(r), F.col(r))])
    tops = _rarest_seen(vocab, has_sid).select(F.col("coll").alias("top_coll"), by_role.alias("tops"))
    weighed = rows.join(per_term, ["qid", "pos"], "left").withColumn("lib", F.lit("library"))
    for key, name in (("lib", "lib_tops"), ("sid", "sid_tops")):
        if key == "lib" or has_sid:
            side = tops.withColumnRenamed("top_coll", key).withColumnRenamed("tops", name)
            weighed = weighed.join(F.broadcast(side), key, "left")
    most = F.col("lib_tops")[F.col("role")]
    if has_sid:
        most = F.greatest(most, F.col("sid_tops")[F.col("role")])
    weight = F.least(F.lit(V.MAX_IDF_WEIGHT), F.coalesce("own_idf", most, F.lit(V.EMPTY_IDF_WEIGHT)))
    term = F.struct("pos", "term", weight.alias("weight"), F.coalesce("rarity", F.lit(0.0)).alias("rarity"),
                    F.col("rarity").isNotNull().alias("known"), "variants")
    # a question is at most 400 characters, so its list is short
    listed_terms = weighed.groupBy("qid").agg(F.array_sort(F.collect_list(term)).alias("terms"))
    out = base.join(listed_terms, "qid", "left").withColumn("terms", F.coalesce("terms", empty_array(TERM)))

    generic = glossary.question_words()
    specific = F.filter("terms", lambda t: t["known"] & ~t["term"].isin(generic))
    rare_first = F.array_sort(F.transform(specific, lambda t: F.struct((-t["rarity"]).alias("r"), t["pos"], t["term"], t["variants"])))
    unknown = F.filter("terms", lambda t: ~t["known"] & (F.length(t["term"]) >= 3) & ~t["term"].isin(generic))
    out = out.withColumn("top", F.slice(rare_first, 1, 2))
    return out.select(
        "qid", "q", F.when(is_arabic(F.col("q")), "ar").otherwise("en").alias("lang"), "role", "sid", "terms",
        F.transform(unknown, lambda t: t["term"]).alias("unknown"),
        F.transform("top", lambda t: t["term"]).alias("keys"),
        F.array_distinct(F.flatten(F.transform("top", lambda t: t["variants"]))).alias("key_variants"),
        pairs(F.col("own")).alias("pairs"),
        F.col("q").rlike(V.NUMERIC_QUESTION).alias("wants_number"))


def coverage(terms: Column, have: Column) -> Column:
    """Share of the question's term weight that a token list holds, translations counting."""
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["weight"])
    got = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.when(
        F.arrays_overlap(t["variants"], have), t["weight"]).otherwise(0.0))
    return F.when(total > 0, got / total).otherwise(0.0)


def support(terms: Column, key_variants: Column, have: Column) -> Column:
    """Coverage of a passage that holds one of the question's two most specific terms, else 0."""
    return F.when(F.arrays_overlap(key_variants, have), coverage(terms, have)).otherwise(0.0)
