"""Personal data: exact spans, masking by role, and counts, as Catalyst expressions.

A pattern's matches and the gaps between them (``regexp_extract_all`` and ``split``) give every match its
offset, so overlapping finds of different kinds can be settled on the original text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.common import by_name, empty_array, let

SPAN = "STRUCT<start: INT, end: INT, kind: STRING>"

# Cheap tests that every match of the kind passes; most texts stop here.
_HINTS = {
    "emirates_id": lambda t: t.contains("784"),
    "iban": lambda t: t.rlike(rf"(?iu)AE{V.WS}?\p{{Nd}}"),
    "passport": lambda t: t.rlike("(?iu)passport"),
    "phone": lambda t: t.rlike(rf"(?:971|0){V.WS}?5"),
    "email": lambda t: t.contains("@"),
    "card": lambda t: t.rlike(r"(?:\p{Nd}[ -]?){13}"),
}

# What a match begins with, looked at before the dearer test for a word's edge; it leaves no match out.
_BEGINS = {
    "emirates_id": "784",
    "iban": "[Aa][Ee]",
    "passport": "[Pp][Aa]",
    "phone": "[+0]",
    "email": "[A-Za-z0-9._%+-]++@",
    "card": r"\p{Nd}",
}


def quick_pattern(kind: str) -> str:
    """The pattern of a kind, with the same matches, that gives up early where none can begin."""
    return f"(?={_BEGINS[kind]}){V.PII_PATTERNS[kind]}"


def luhn(number: Column) -> Column:
    """13 to 19 digits with a valid check digit; separators do not count."""
    digits = F.regexp_replace(F.translate(number, V.AR_DIGITS, "0123456789"), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def is_shared_mailbox(address: Column) -> Column:
    return address.rlike(V.SHARED_MAILBOX)


def _of_kind(text: Column, kind: str) -> Column:
    pattern = quick_pattern(kind)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern).alias("gap"))
    start = F.expr(f"CAST(named_struct('at', 0, 'spans', array()) AS STRUCT<at: INT, spans: ARRAY<{SPAN}>>)")

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + F.length(m["gap"]) + F.length(m["whole"])
        # a passport's span is its number, which ends the match
        part = F.regexp_extract(m["whole"], pattern, 1) if kind == "passport" else m["whole"]
        span = F.struct((end - F.length(part)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        keep = F.lit(True)
        if kind == "card":
            keep = luhn(m["whole"])
        elif kind == "email":
            keep = ~is_shared_mailbox(m["whole"])
        return F.struct(end.alias("at"),
                        F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    # the last gap follows the last match and has no partner
    walked = F.aggregate(F.filter(found, lambda m: m["whole"].isNotNull()), start, step)["spans"]
    return F.when(_HINTS[kind](text), walked).otherwise(empty_array(SPAN))


@by_name
def spans(text: Column) -> Column:
    """Identifiers in text order. Kinds are tried in precedence order; a later span that overlaps is dropped."""
    found = F.concat(*[_of_kind(text, kind) for kind in V.PII_PATTERNS])

    def settle(candidates: Column) -> Column:
        def add(kept: Column, s: Column) -> Column:
            clash = F.exists(kept, lambda o: (s["end"] > o["start"]) & (s["start"] < o["end"]))
            return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

        one = F.size(candidates) < 2
        return F.when(one, candidates).otherwise(
            F.array_sort(F.aggregate(candidates, empty_array(SPAN), add)))

    return let(found, settle)


def hidden_spans(found: Column, see_contacts: Column) -> Column:
    """Spans to mask: identifiers always, phone numbers and addresses unless the reader may see contacts."""
    return F.filter(found, lambda s: s["kind"].isin(V.PII_ALWAYS) | ~see_contacts)


def may_see_contacts(role: Column, contacts_ok: Column) -> Column:
    return F.coalesce(role.isin(V.CONTACT_ROLES) & contacts_ok, F.lit(False))


def mask(text: Column, hide: Column) -> Column:
    """Replace the given spans by their label."""
    label = F.create_map(*[F.lit(x) for kv in V.PII_LABELS.items() for x in kv])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"),
                        F.concat(acc["out"], clear, F.lit("["), label[s["kind"]], F.lit(" HIDDEN]")).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(hide) == 0, text).otherwise(F.aggregate(hide, start, step, finish))


def counts(found: Column) -> Column:
    """map<kind, count> of the kinds that occur."""
    kinds = F.array(*[F.lit(k) for k in V.PII_PATTERNS])
    per_kind = F.transform(kinds, lambda k: F.struct(
        k.alias("kind"), F.size(F.filter(found, lambda s: s["kind"] == k)).alias("n")))
    return F.map_from_entries(F.filter(per_kind, lambda e: e["n"] > 0))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind))
