"""Planted instructions: detection and removal, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.common import by_name, let
from docvault.functions.text import lines, nfkc, normalise_ar, sentences


def is_injection(c: Column, fold_width: bool = False) -> Column:
    """Whether a text tries to instruct an assistant. ``fold_width=True`` also sees full-width disguises."""
    return normalise_ar(nfkc(c) if fold_width else c).rlike(V.INJECTION)


@by_name
def sanitise(c: Column) -> Column:
    """struct<text, removed>: flagged sentences dropped and counted; clean lines kept as they are."""

    def clean_line(line: Column) -> Column:
        def split_flagged(parts: Column) -> Column:
            kept = F.filter(parts, lambda s: ~is_injection(s))
            return F.struct(F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("text"),
                            (F.size(parts) - F.size(kept)).alias("removed"))

        untouched = F.struct(line.alias("text"), F.lit(0).alias("removed"))
        return F.when(is_injection(line), let(sentences(line), split_flagged)).otherwise(untouched)

    def rebuild(parts: Column) -> Column:
        text = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
        removed = F.aggregate(parts, F.lit(0), lambda acc, p: acc + p["removed"])
        return F.struct(text.alias("text"), removed.alias("removed"))

    return let(F.transform(lines(c), clean_line), rebuild)


def flagged_lines(c: Column) -> Column:
    """Trimmed lines that would be removed, for the document reader."""
    from docvault.functions.text import strip

    kept = F.filter(F.split(c, "\n"), lambda x: (strip(x) != "") & is_injection(x))
    return F.transform(kept, strip)
