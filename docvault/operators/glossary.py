"""Arabic and English workplace glossary: one-hop expansion of tokens, in both directions.

The glossary is a fixed table of a few hundred terms, so it travels inside the plan as a literal map and a
set test decides which tokens look anything up.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions.common import by_name, let
from docvault.functions.text import AR_STEM_STEPS


def plain_stem(word: str) -> str:
    """The stem of one fixed-table word (the same rules as the column functions)."""
    if re.match("[ء-ي]", word):
        for step in AR_STEM_STEPS:
            word = re.sub(step, "", word)
        return word
    for ending, put in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if re.search(f".{{3}}{ending}$", word) and not word.endswith("ss"):
            return word[:len(word) - len(ending)] + put
    return word


def _fold(word: str) -> str:
    return word.translate(str.maketrans(*V.AR_FOLD))


def _rows(table: str) -> list[tuple[list[str], list[str]]]:
    pairs = (line.split(" = ") for line in table.strip().splitlines())
    return [([plain_stem(_fold(w)) for w in a.split()], [plain_stem(w) for w in b.split()]) for a, b in pairs]


@cache
def tables() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(variants of single tokens, translations of phrases), each list without repeats."""
    words: dict[str, dict[str, None]] = {}
    phrases: dict[str, dict[str, None]] = {}
    for arabic, english in _rows(V.ARABIC_TO_ENGLISH):
        target = words if len(arabic) == 1 else phrases
        target.setdefault(" ".join(arabic), {}).update(dict.fromkeys(english))
        for e in english:
            words.setdefault(e, {}).update(dict.fromkeys(arabic))
    for left, right in _rows(V.ENGLISH_SYNONYMS):
        for a in left:
            for b in right:
                words.setdefault(a, {})[b] = None
                words.setdefault(b, {})[a] = None
    return {k: list(v) for k, v in words.items()}, {k: list(v) for k, v in phrases.items()}


@cache
def question_words() -> list[str]:
    return sorted({plain_stem(w) for w in V.QUESTION_WORDS})


def _literal_map(table: dict[str, list[str]]) -> Column:
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string, array<string>>")


@by_name
def variants(token: Column) -> Column:
    """The token and its translations and synonyms."""
    words, _ = tables()
    known = F.when(token.isin(list(words)), _literal_map(words)[token])
    return F.array_union(F.array(token), F.coalesce(known, F.array().cast("array<string>")))


@by_name
def expansion(tokens: Column) -> Column:
    """Translations and synonyms that are not among the tokens themselves, with repeats."""
    words, phrases = tables()

    def extra(ts: Column) -> Column:
        hits = F.filter(ts, lambda t: t.isin(list(words)))
        of_words = F.flatten(F.transform(hits, lambda t: _literal_map(words)[t]))
        # phrases are Arabic: texts without Arabic tokens skip the search
        joined = F.array_join(ts, " ")
        keys = F.array(*[F.lit(p) for p in phrases])
        found = F.filter(keys, lambda p: F.contains(joined, p))
        of_phrases = F.when(joined.rlike(V.AR_LETTERS),
                            F.flatten(F.transform(found, lambda p: _literal_map(phrases)[p])))
        both = F.concat(F.coalesce(of_phrases, F.array().cast("array<string>")), of_words)
        return F.filter(both, lambda x: ~F.array_contains(ts, x))

    return let(tokens, extra)
