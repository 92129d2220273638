"""Scalar text functions as Catalyst expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.common import by_name, let


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{V.WS}+|{V.WS}+\z", "")


def lines(c: Column) -> Column:
    """Lines of a text; like a line reader, a final line end opens no further line."""
    return F.split(F.regexp_replace(c, rf"(?:{V.EOL})\z", ""), V.EOL)


def nfkc(c: Column) -> Column:
    """Unicode compatibility folding by the ICU library that ships with Spark; plain ASCII is left alone."""
    folded = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def normalise_ar(c: Column) -> Column:
    """Drop Arabic marks and fold letter variants; texts without Arabic pass untouched."""
    folded = F.translate(F.regexp_replace(c, V.AR_MARKS, ""), *V.AR_FOLD)
    return F.when(c.rlike(V.AR_LETTERS), folded).otherwise(c)


def is_arabic(c: Column) -> Column:
    """More than 40 % of the letters are Arabic."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    arabic = F.length(F.regexp_replace(letters, r"[^\x{600}-\x{6FF}]", ""))
    return c.rlike(V.AR_LETTERS) & (arabic / F.length(letters) > 0.4)


def stem_en(w: Column) -> Column:
    """Cut the first plural or tense ending that leaves three letters; words in -ss stay."""
    n = F.length(w)

    def cut(ending: str, put: str = "") -> tuple[Column, Column]:
        fits = w.endswith(ending) & (n >= len(ending) + 3)
        stem = F.substring(w, F.lit(1), n - len(ending))
        return fits, F.concat(stem, F.lit(put)) if put else stem

    out = F.when(w.endswith("ss"), w)
    for ending, put in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        out = out.when(*cut(ending, put))
    return out.otherwise(w)


# Each step needs three letters to remain; a longer ending is found before a shorter one inside it.
AR_STEM_STEPS = [
    rf"^(?:{'|'.join(V.AR_PREFIXES)})(?=.{{3}})",
    "^و(?=.{4})",
    "^(?!لل)[لبكف](?=.{3})",
    rf"(?<=.{{3}})(?:{'|'.join(V.AR_SUFFIXES)})$",
]


def stem_ar(w: Column) -> Column:
    for step in AR_STEM_STEPS:
        w = F.regexp_replace(w, step, "")
    return w


def _stem_token(t: Column) -> Column:
    return (F.when((t >= "a") & (t < "{"), stem_en(t))
            .when((t >= "ء") & (t < "ً"), stem_ar(t))
            .otherwise(F.replace(t, F.lit(","), F.lit(""))))


# ``V.TOKEN`` on lower-cased text, without trying shorter runs: what follows a run is never in it.
_TOKEN = r"[a-z]++\p{Nd}*+|[\x{621}-\x{64A}]++|\p{Nd}++(?:[.,]\p{Nd}++)*+%?+"


def raw_tokens(c: Column, fold_width: bool = True) -> Column:
    """Words and numbers in order, lower-cased, before stop words and stems."""
    folded = F.lower(normalise_ar(nfkc(c) if fold_width else c))
    return F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(0))


def finish_tokens(raw: Column, stem: bool = True, stop: bool = True) -> Column:
    """Stop-word removal and stemming of ``raw_tokens`` output."""
    out = raw
    if stop:
        words = [*dict.fromkeys(V.EN_STOP), *dict.fromkeys(V.AR_STOP)]
        out = F.filter(out, lambda t: ~t.isin(words))
    return F.transform(out, _stem_token if stem else _plain_token)


def _plain_token(t: Column) -> Column:
    is_word = ((t >= "a") & (t < "{")) | ((t >= "ء") & (t < "ً"))
    return F.when(is_word, t).otherwise(F.replace(t, F.lit(","), F.lit("")))


@by_name
def tokens(c: Column, stem: bool = True, stop: bool = True, fold_width: bool = True) -> Column:
    """Index terms of a text, in order and with repeats.

    ``fold_width=False`` skips the Unicode compatibility folding for text known to need none.
    """
    return finish_tokens(raw_tokens(c, fold_width), stem, stop)


@by_name
def sentences(c: Column) -> Column:
    """Sentences longer than two characters; a list item stays whole, without its marker."""

    def of_line(line: Column) -> Column:
        item = F.array(F.regexp_replace(line, V.LIST_MARKER, ""))
        prose = F.transform(F.split(line, V.SENTENCE_GAP), strip)
        return F.when(line.rlike(V.LIST_MARKER), item).otherwise(prose)

    stripped = F.transform(lines(c), strip)
    return F.filter(F.flatten(F.transform(stripped, of_line)), lambda s: F.length(s) > 2)


def pairs(tokens_col: Column) -> Column:
    """Distinct adjacent token pairs."""
    n = F.greatest(F.size(tokens_col) - 1, F.lit(0))
    both = F.zip_with(F.slice(tokens_col, F.lit(1), n), F.slice(tokens_col, F.lit(2), n),
                      lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(both)


def numbers(c: Column) -> Column:
    """Distinct numbers of a text, Arabic-Indic digits as ASCII and without thousands commas."""
    found = F.regexp_extract_all(F.translate(c, V.AR_DIGITS, "0123456789"), F.lit(V.NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def is_digits(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}+$")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"{V.WS}+"), lambda w: w != ""))


def question_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def run_lengths(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms, counted within the row."""
    def of_sorted(ordered: Column) -> Column:
        n = F.size(ordered)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(ordered, i).alias("term"), (F.coalesce(F.get(s, k + 1), n) - i).cast("bigint").alias("tf"))))

    return let(F.sort_array(terms), of_sorted)
