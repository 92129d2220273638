"""Passages: documents cut at headings, then by size with overlap, in expressions only.

The size rule is a state machine. Separators are tried from the coarsest on: a piece of at least the size is cut before each
occurrence of the next separator, shorter pieces stay. Pieces that stand side by side within one cut form a run, which a long piece
between them ends. A fold then walks the pieces' lengths with the open window as its state and closes a window where the next
piece would exceed the size; the next one keeps whole pieces of at most the overlap. Single characters have windows at
regular places, so they are cut without a walk.

Nothing is cut off, whatever a text's length; a null text or an empty one has no passage. Rows that share an id are cut each by
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.common import empty_array, let
from docvault.functions.text import strip
from docvault.operators.access import access_mask

_HEADING = r"(?md)^#[^\n]*"
_OTHER_EOL = r"[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_LITERAL = str.maketrans({c: "\\" + c for c in ".?"})


def _cut_before(text: Column, separator: str, size: int) -> Column:
    """array<struct<t, new>>: parts of a text, each but the first beginning with the separator; ``new`` opens a run."""
    parts = F.split(text, separator.translate(_LITERAL), -1)
    parts = F.filter(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p))), lambda p: p != "")
    return let(parts, lambda ps: F.transform(ps, lambda p, i: F.struct(
        p.alias("t"), ((i == 0) | (F.length(F.get(ps, i - 1)) >= size)).alias("new"))))


def _lengths(piece: Column, size: int, overlap: int) -> Column:
    """array<struct<n, step, new>>: a piece's length and how far the next one begins; a text without separators as its windows."""
    n, step = F.length(piece["t"]), size - min(overlap, size - 1)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0)))

    def window(k: Column) -> Column:
        left = n - k * step
        return F.struct(F.least(left, F.lit(size)).alias("n"), F.when(left <= size, left).otherwise(step).alias("step"), F.lit(True).alias("new"))

    windows = F.transform(starts, window)
    return F.when(n >= size, windows).otherwise(F.array(F.struct(n.alias("n"), n.alias("step"), piece["new"].alias("new"))))


def window_spans(text: Column, size: int = V.PASSAGE_SIZE, overlap: int = V.PASSAGE_OVERLAP) -> Column:
    """array<struct<a, b>>: windows of a text, from ``a`` to before ``b``, not stripped yet."""
    pieces = F.array(F.struct(text.alias("t"), F.lit(True).alias("new")))

    def cut(pieces: Column, separator: str) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p["t"]) >= size, _cut_before(p["t"], separator, size)).otherwise(F.array(p))))

    for separator in filter(None, V.SEPARATORS):
        pieces = cut(pieces, separator)
    lengths = F.flatten(F.transform(pieces, lambda p: _lengths(p, size, overlap)))

    def closed(s: Column) -> Column:
        window = F.struct(s["held"][0].alias("a"), s["end"].alias("b"))
        return F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(window))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        # ``held``: where the pieces of the open window begin.
        a, b = s["at"], s["at"] + p["n"]
        full = b - F.coalesce(F.get(s["held"], F.lit(0)), a) > size
        held = (F.when(p["new"], F.array(a)).when(full, F.concat(F.filter(s["held"], lambda x: (a - x <= overlap) & (b - x <= size)), F.array(a)))
                .otherwise(F.concat(s["held"], F.array(a))))
        out = F.when(p["new"] | full, closed(s)).otherwise(s["out"])
        return F.struct((a + p["step"]).alias("at"), b.alias("end"), held.alias("held"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), empty_array("int").alias("held"), empty_array("struct<a:int,b:int>").alias("out"))
    return F.aggregate(lengths, start, step, closed)


def split_text(text: Column, size: int = V.PASSAGE_SIZE, overlap: int = V.PASSAGE_OVERLAP) -> Column:
    """array<string>: passages of a text, stripped, none empty."""
    return let(text, lambda t: F.filter(F.transform(window_spans(t, size, overlap), lambda w: strip(F.substring(t, w["a"] + 1, w["b"] - w["a"]))), lambda x: x != ""))


def blocks_of(title: Column, text: Column) -> Column:
    """array<struct<section, body>>: text under each heading; before the first heading the title stands in."""
    plain = F.when(text.rlike(_OTHER_EOL), F.regexp_replace(text, V.EOL, "\n")).otherwise(text)

    def cut(t: Column) -> Column:
        headings = F.transform(F.regexp_extract_all(t, F.lit(_HEADING), F.lit(0)), lambda h: strip(F.regexp_replace(h, "^[# ]+", "")))
        return F.zip_with(F.concat(F.array(title), headings), F.transform(F.split(t, _HEADING, -1), strip), lambda s, b: F.struct(s.alias("section"), b.alias("body")))

    # Most texts have no heading; they are spared its search.
    both = let(plain, lambda t: F.when(F.contains(t, F.lit("#")), cut(t)).otherwise(F.array(F.struct(title.alias("section"), strip(t).alias("body")))))
    return F.filter(both, lambda x: x["body"] != "")


def passages(documents: DataFrame) -> DataFrame:
    """(coll, doc, n, title, section, text, mask, superseded) of documents; n counts from 0 in a document."""
    blocks = documents.select(
        "coll", F.col("id").alias("doc"), "title", access_mask(F.col("access")).alias("mask"),
        (F.col("status") == "superseded").alias("superseded"), blocks_of(F.col("title"), F.col("text")).alias("blocks"))
    numbered = F.flatten(F.transform("blocks", lambda b: F.transform(split_text(b["body"]), lambda p: F.struct(b["section"].alias("section"), p.alias("text")))))
    return blocks.select("coll", "doc", "title", "mask", "superseded", F.posexplode(numbered).alias("n", "p")).select(
        "coll", "doc", "n", "title", "p.section", "p.text", "mask", "superseded")


def whole_documents(documents: DataFrame) -> DataFrame:
    """Each document as a single passage under its title."""
    return documents.select(
        "coll", F.col("id").alias("doc"), F.lit(0).alias("n"), "title", F.col("title").alias("section"), "text",
        access_mask(F.col("access")).alias("mask"), (F.col("status") == "superseded").alias("superseded"))
