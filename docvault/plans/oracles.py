"""SQL that computes the registered queries on the same tables, for checking them."""

from __future__ import annotations

import re

from docvault import fixed_values as V
from docvault.operators import glossary
from docvault.plans.queries import HALF_DAY, NOON

ORACLES: dict[str, str] = {}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _stem(t: str) -> str:
    cut = "\n".join(f"WHEN {t} LIKE '%{end}' AND length({t}) >= {len(end) + 3} THEN left({t}, length({t}) - {len(end)}) || '{put}'"
                    for end, put in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")))
    return f"CASE WHEN {t} < 'a' THEN replace({t}, ',', '') WHEN {t} LIKE '%ss' THEN {t} {cut} ELSE {t} END"


WORDS = "[a-z]+[0-9]+|[a-z]+|[0-9]+(?:[.,][0-9]+)*%?"


def _tokens(text: str) -> str:
    raw = f"regexp_extract_all(lower({text}), '{WORDS}')"
    return (f"list_transform(list_filter({raw}, lambda t: t NOT IN ({_quoted(dict.fromkeys(V.EN_STOP))})), "
            f"lambda t: {_stem('t')})")


_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ITEM = r"^(?:[-•*]|[0-9]+[.)])\s+"
_GAP = r"([.!?؟])\s+([A-Z\x{600}-\x{6FF}0-9\"(])"


def _sentences(text: str) -> str:
    lines = f"list_transform(string_split({text}, chr(10)), lambda l: {_STRIPPED.format('l')})"
    prose = f"list_transform(string_split(regexp_replace(l, '{_GAP}', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: {_STRIPPED.format('p')})"
    each = f"CASE WHEN regexp_matches(l, '{_ITEM}') THEN [regexp_replace(l, '{_ITEM}', '')] ELSE {prose} END"
    return f"list_filter(flatten(list_transform({lines}, lambda l: {each})), lambda s: length(s) > 2)"


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_CARD = r"\b(?:[0-9][ -]?){13,19}\b"
_SHARED = r"(?i)^(hr|hr\.desk|security|dpo|ethics|info|support|procurement|careers|finance|legal|it)@"


def _luhn(c: str) -> str:
    d = f"regexp_replace({c}, '[ -]', '', 'g')"
    digit = f"CAST({d}[length({d}) - i + 1] AS INT)"
    return (f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
            f"WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0)")


def _emails(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{_EMAIL}'), lambda e: NOT regexp_matches(e, '{_SHARED}'))"


def _cards(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{_CARD}'), lambda c: {_luhn('c')})"


def _replaced(text: str, seen: str, pattern: str, hidden: str, label: str) -> str:
    """``text`` with matches found in ``seen``, a text of the same length, replaced where ``hidden`` ($m) holds."""
    found = f"regexp_extract_all({seen}, '{pattern}')"
    gaps = f"regexp_split_to_array({seen}, '{pattern}')"
    before = f"CAST(coalesce(list_sum(list_transform({gaps}[1:k - 1] || {found}[1:k - 1], lambda g: length(g))), 0) AS BIGINT)"
    parts = (f"list_transform(range(1, len({found}) + 1), lambda k: substr({text}, {before} + 1, length({gaps}[k])) || "
             f"CASE WHEN {hidden.replace('$m', found + '[k]')} THEN '[{label} HIDDEN]' ELSE {found}[k] END)")
    rest = f"right({text}, length({gaps}[len({found}) + 1]))"
    return f"CASE WHEN len({found}) = 0 THEN {text} ELSE array_to_string({parts}, '') || {rest} END"


def _masked(text: str) -> str:
    """Cards first: their borders are looked for beside unmasked neighbours. Accented letters count as letters there."""
    plain = f"regexp_replace({text}, '[^\\x00-\\x7F]', 'x', 'g')"
    cards = _replaced(text, plain, _CARD, _luhn("$m"), "CARD NUMBER")
    emails = _replaced("x", "x", _EMAIL, f"NOT regexp_matches($m, '{_SHARED}')", "EMAIL")
    return f"list_transform([{cards}], lambda x: {emails})[1]"


def _injected(text: str) -> str:
    marks = "[\\x{610}-\\x{61A}\\x{64B}-\\x{65F}\\x{670}\\x{6D6}-\\x{6ED}\\x{640}]"
    pattern = V.INJECTION.replace("(?iu)", "(?i)").replace(V.WS, r"\s")
    return f"regexp_matches(translate(regexp_replace({text}, '{marks}', '', 'g'), '{V.AR_FOLD[0]}', '{V.AR_FOLD[1]}'), '{pattern}')"


def _clean(text: str) -> str:
    """struct(line or null, removed) per line."""
    sents = _sentences("l")
    kept = f"list_filter({sents}, lambda s: NOT {_injected('s')})"
    return (f"list_transform(string_split(regexp_replace({text}, '\\n$', ''), chr(10)), lambda l: CASE WHEN {_injected('l')} THEN "
            f"{{'line': CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') END, 'removed': len({sents}) - len({kept})}} "
            f"ELSE {{'line': l, 'removed': 0}} END)")


_pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_numbers = "list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)*'), lambda x: replace(x, ',', '')))"


def _glossary_rows() -> str:
    words, _ = glossary.tables()
    rows = [(k, v) for k, vs in words.items() if k.isascii() for v in vs]
    return ", ".join(f"({_quoted([k])}, {_quoted([v])})" for k, v in rows)


ROLE_LIST = f"[{_quoted(V.ROLES)}]"
NUMERIC = V.NUMERIC_QUESTION.replace("(?iu)", "(?i)").replace(V._EDGE, r"\b").replace(V._WORD, r"\w")

# library, index, questions and their terms
BASE = f"""
lib AS MATERIALIZED (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS doc, 'doc ' || doc_id AS title, text, lang, source,
         CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 7 AS cls,
         max(doc_id) OVER (PARTITION BY text) > doc_id AS superseded
  FROM documents),
gloss(term, variant) AS (VALUES {_glossary_rows()}),
idx AS MATERIALIZED (SELECT *, {_tokens("title || '. ' || text")} AS toks FROM lib),
tf AS MATERIALIZED (
  SELECT doc, cls, superseded, source, n, term, count(*) AS tf
  FROM (SELECT doc, cls, superseded, source, len(toks) AS n, unnest(toks) AS term FROM idx) GROUP BY ALL),
stats AS (SELECT count(*) AS passages, avg(len(toks)) AS mean_length FROM idx),
vocab AS MATERIALIZED (
  SELECT term, ln(1 + (any_value(passages) - count(*) + 0.5) / (count(*) + 0.5)) AS idf,
         [bool_or(cls IN (6, 0)), bool_or(cls IN (6, 1)), bool_or(cls IN (6, 2)), bool_or(cls IN (6, 3)), bool_or(cls IN (6, 4)), true] AS vis
  FROM tf, stats GROUP BY term),
tops AS (SELECT r, max(idf) AS top, count(*) AS terms FROM vocab, range(0, 6) t(r) WHERE vis[r + 1] GROUP BY r),
q AS MATERIALIZED (SELECT item_id AS qid, text AS q, item_id % 6 AS r, {_tokens('text')} AS own FROM benchmark),
qw AS MATERIALIZED (
  SELECT qid, r, term, 1.0 AS weight FROM (SELECT DISTINCT qid, r, unnest(own) AS term FROM q)
  UNION ALL
  SELECT DISTINCT t.qid, t.r, g.variant, {V.EXPANSION_WEIGHT} FROM (SELECT qid, r, own, unnest(own) AS term FROM q) t
  JOIN gloss g ON g.term = t.term WHERE NOT list_contains(t.own, g.variant))
"""


def _part(df_from: str) -> str:
    return (f"w.weight * {df_from} * tf.tf * {V.BM25_K1 + 1} / (tf.tf + {V.BM25_K1} * "
            f"({1 - V.BM25_B} + {V.BM25_B} * tf.n / mean_length))")


def _hits(allowed: str) -> str:
    return f"""
scored AS MATERIALIZED (
  SELECT w.qid, tf.doc, tf.superseded, round(sum({_part('v.idf')}), 9) AS bm25
  FROM qw w JOIN tf ON tf.term = w.term JOIN vocab v ON v.term = w.term, stats
  WHERE {allowed} GROUP BY ALL HAVING round(sum({_part('v.idf')}), 9) > 0),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc) - 1 AS rk FROM scored QUALIFY rk < 20),
fused AS (SELECT *, round(1.0 / ({V.RRF_K} + rk) * CASE WHEN superseded THEN {V.SUPERSEDED_FACTOR} ELSE 1 END, 12) AS score FROM cand),
hits AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank FROM fused QUALIFY rank < 5)
"""


PERMITTED = "(tf.cls = 6 OR tf.cls = w.r OR w.r = 5)"

PROFILE = f"""
qt AS (
  SELECT qid, r, term, min(pos) AS pos FROM (SELECT qid, r, unnest(own) AS term, generate_subscripts(own, 1) AS pos FROM q)
  WHERE NOT regexp_full_match(term, '[0-9]+') GROUP BY ALL),
qv AS (SELECT qid, r, term, pos, term AS variant FROM qt UNION SELECT qid, r, qt.term, pos, g.variant FROM qt JOIN gloss g ON g.term = qt.term),
seen AS (
  SELECT qid, qv.term, max(idf) AS rarity, max(idf) FILTER (WHERE qv.variant = qv.term) AS own_idf
  FROM qv JOIN vocab v ON v.term = qv.variant WHERE v.vis[r + 1] GROUP BY ALL),
terms AS MATERIALIZED (
  SELECT qt.qid, qt.r, qt.term, pos, rarity, least(6.0, coalesce(own_idf, top, 3.0)) AS weight,
         qt.term IN ({_quoted(glossary.question_words())}) AS generic,
         (SELECT list(variant) FROM qv WHERE qv.qid = qt.qid AND qv.term = qt.term) AS variants
  FROM qt LEFT JOIN seen USING (qid, term) LEFT JOIN tops USING (r)),
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rarity DESC, pos) AS k FROM terms
  WHERE rarity IS NOT NULL AND NOT generic QUALIFY k <= 2),
prof AS MATERIALIZED (
  SELECT q.qid, q.r, q.q, q.own,
         coalesce((SELECT list(term ORDER BY k) FROM keyed WHERE keyed.qid = q.qid), []) AS keys,
         coalesce((SELECT list_distinct(flatten(list(variants))) FROM keyed WHERE keyed.qid = q.qid), []) AS key_variants,
         coalesce((SELECT list(term ORDER BY pos) FROM terms t WHERE t.qid = q.qid AND rarity IS NULL AND length(term) >= 3
                   AND NOT generic), []) AS unknown,
         (SELECT count(*) FROM terms t WHERE t.qid = q.qid) AS n_terms,
         {_pairs.format('own')} AS pairs,
         regexp_matches(q.q, '{NUMERIC}') AS wants_number
  FROM q)
"""

SUPPORT = f"""
src AS MATERIALIZED (
  SELECT h.qid, h.doc, h.rank, h.superseded, i.title, i.text, {_tokens('i.title')} AS head, {_tokens('i.text')} AS body,
         p.key_variants, p.pairs, p.wants_number
  FROM hits h JOIN idx i ON i.doc = h.doc JOIN prof p ON p.qid = h.qid),
sup AS MATERIALIZED (
  SELECT s.*, round(CASE WHEN list_has_any(key_variants, head || body) THEN
    (SELECT sum(CASE WHEN list_has_any(t.variants, s.head || s.body) THEN weight ELSE 0 END) / sum(weight) FROM terms t WHERE t.qid = s.qid)
    ELSE 0 END, 9) AS support FROM src s),
gate AS MATERIALIZED (
  SELECT p.qid, coalesce(b.best, 0) AS best,
         (len(unknown) >= 2 AND coalesce(b.best, 0) < 0.75) OR (len(unknown) = 1 AND coalesce(b.best, 0) < 0.6) AS missing,
         missing OR coalesce(b.best, 0) < {V.MIN_SUPPORT} AS refuse
  FROM prof p LEFT JOIN (SELECT qid, max(support) AS best FROM sup GROUP BY qid) b USING (qid))
"""

SENTENCES = f"""
sent AS MATERIALIZED (
  SELECT *, {_tokens('sentence')} AS st FROM (
    SELECT * EXCLUDE (sents), unnest(sents) AS sentence, generate_subscripts(sents, 1) - 1 AS pos
    FROM (SELECT *, {_sentences('text')} AS sents FROM sup WHERE support >= {V.MIN_SUPPORT}))),
graded AS MATERIALIZED (
  SELECT s.qid, s.doc, s.rank, s.pos, s.sentence, s.support, s.superseded,
    round(0.5 * (SELECT sum(CASE WHEN list_has_any(t.variants, s.head || s.st) THEN weight ELSE 0 END) / sum(weight) FROM terms t WHERE t.qid = s.qid)
      + 0.5 * (SELECT sum(CASE WHEN list_has_any(t.variants, s.st) THEN weight ELSE 0 END) / sum(weight) FROM terms t WHERE t.qid = s.qid)
      + 0.15 * s.support - 0.03 * s.rank
      + 0.12 * least(2, len(list_intersect(s.pairs, {_pairs.format('s.st')})))
      - CASE WHEN s.superseded THEN 0.3 ELSE 0 END
      + CASE WHEN s.wants_number AND regexp_matches(s.sentence, '[0-9]') THEN 0.12 ELSE 0 END, 9) AS score
  FROM sent s WHERE list_has_any(s.key_variants, s.head || s.st)),
placed AS (
  SELECT g.*, row_number() OVER (PARTITION BY g.qid ORDER BY score DESC, rank, pos) AS place
  FROM graded g JOIN gate USING (qid) WHERE NOT refuse QUALIFY place <= 4),
best AS (SELECT * FROM placed WHERE place = 1),
near AS (
  SELECT p.* FROM placed p JOIN best b USING (qid)
  WHERE p.place > 1 AND p.rank = b.rank AND abs(p.pos - b.pos) = 1 AND p.score >= 0.85 * b.score
  QUALIFY row_number() OVER (PARTITION BY p.qid ORDER BY p.place) = 1),
picked AS (
  SELECT qid, string_agg(rtrim(sentence), ' ' ORDER BY pos) AS picked FROM (SELECT * FROM best UNION ALL SELECT * FROM near) GROUP BY qid),
safe AS MATERIALIZED (
  SELECT g.qid, p.picked IS NULL AS refused,
    CASE WHEN p.picked IS NULL THEN '{V.REFUSAL["en"].replace("'", "''")}'
         WHEN regexp_matches(p.picked, '[.?!؟]$') THEN p.picked || ' [' || b.rank + 1 || ']' ELSE p.picked || '. [' || b.rank + 1 || ']' END AS text,
    b.rank + 1 AS cite, b.doc AS cited_doc,
    CASE WHEN p.picked IS NOT NULL THEN b.support WHEN refuse THEN best ELSE 0 END AS support,
    CASE WHEN p.picked IS NOT NULL AND b.superseded THEN 'superseded_source' WHEN missing THEN 'unknown_term' ELSE '' END AS notes
  FROM gate g LEFT JOIN picked p USING (qid) LEFT JOIN best b USING (qid))
"""


def _with(*parts: str, select: str) -> str:
    return f"WITH {','.join(parts)} {select}"


O = ORACLES
O["token_counts"] = f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)"
O["term_df_topn"] = f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL)
  GROUP BY term ORDER BY df DESC, term LIMIT 50"""
O["stem_en_terms"] = f"""SELECT word, {_stem('word')} AS stem, n FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS word FROM documents)
  WHERE word >= 'a' AND word < '{{' GROUP BY word)"""
O["number_tokens"] = f"SELECT number, count(*) AS n_docs FROM (SELECT unnest({_numbers.format('text')}) AS number FROM documents) GROUP BY number"
O["sentence_counts"] = f"""SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest,
  coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::INT AS chars FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)"""
O["bigram_counts"] = f"SELECT doc_id, len({_pairs.format('t')}) AS n_pairs FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)"
O["arabic_flags"] = f"""SELECT doc_id,
  coalesce(length(regexp_replace(text, '[^\\x{{600}}-\\x{{6FF}}]', '', 'g')) > 0.4 * nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0), false) AS is_arabic,
  md5(translate(regexp_replace(text, '[\\x{{610}}-\\x{{61A}}\\x{{64B}}-\\x{{65F}}\\x{{670}}\\x{{6D6}}-\\x{{6ED}}\\x{{640}}]', '', 'g'), '{V.AR_FOLD[0]}', '{V.AR_FOLD[1]}')) AS normalised_md5
  FROM documents"""
O["question_ids"] = "SELECT item_id, left(sha256(text), 12) AS question_id FROM benchmark"
O["question_expansion"] = f"""WITH gloss(term, variant) AS (VALUES {_glossary_rows()}), c AS (SELECT conv_id, turn, {_tokens('text')} AS own FROM conversations)
  SELECT conv_id, turn, g.variant, count(*) AS n FROM (SELECT conv_id, turn, own, unnest(own) AS term FROM c) t JOIN gloss g ON g.term = t.term
  WHERE NOT list_contains(own, g.variant) GROUP BY ALL"""

O["pii_counts"] = f"""SELECT doc_id, 0 AS emirates_id, 0 AS iban, 0 AS passport, 0 AS phone, len({_emails('text')}) AS email, len({_cards('text')}) AS card FROM documents"""
O["pii_summary"] = f"""SELECT kind, count(*) AS n FROM (SELECT 'email' AS kind, unnest({_emails('text')}) AS x FROM documents
  UNION ALL SELECT 'card', unnest({_cards('text')}) FROM documents) GROUP BY kind"""
O["pii_redacted"] = f"SELECT doc_id, md5(m) AS masked_md5, length(m) AS masked_chars FROM (SELECT doc_id, {_masked('text')} AS m FROM documents)"
O["pii_role_visibility"] = f"""WITH d AS (SELECT source, len({_emails('text')}) AS e, len({_cards('text')}) AS c FROM documents)
  SELECT role, sum(CASE WHEN ok THEN c ELSE c + e END)::BIGINT AS hidden, sum(CASE WHEN ok THEN e ELSE 0 END)::BIGINT AS visible
  FROM (SELECT *, role IN ('it', 'executive') AND source IN ('src3', 'src7') AS ok FROM d, (SELECT unnest({ROLE_LIST}) AS role)) GROUP BY role"""
O["shared_mailbox"] = f"""SELECT address, regexp_matches(address, '{_SHARED}') AS shared, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '{_EMAIL}')) AS address FROM documents) GROUP BY ALL"""
O["luhn_candidates"] = f"""SELECT regexp_replace(c, '[ -]', '', 'g') AS digits, {_luhn('c')} AS valid, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '{_CARD}')) AS c FROM documents) GROUP BY ALL"""
O["scan_preview"] = f"""SELECT conv_id, turn, md5({_masked('text')}) AS masked_md5, len({_emails('text')}) AS emails
  FROM conversations WHERE length(text) BETWEEN 1 AND 5000"""

O["injection_scan"] = f"""SELECT 'documents' AS origin, doc_id AS id, {_injected('text')} AS flagged FROM documents
  UNION ALL SELECT 'pages', page_id, {_injected('html')} FROM pages"""
O["sanitise_lines"] = f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(c, lambda x: x.line), lambda t: t IS NOT NULL), chr(10))) AS clean_md5,
  list_sum(list_transform(c, lambda x: x.removed))::INT AS removed FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)"""

# Positive cases: the same texts are built here, and what is expected of the planted part is written out.
def _stem_ar(w: str) -> str:
    prefixes = " ".join(f"WHEN starts_with({w}, '{p}') AND length({w}) >= {len(p) + 3} THEN substr({w}, {len(p) + 1})" for p in V.AR_PREFIXES)
    one = f"CASE {prefixes} ELSE {w} END"
    two = "CASE WHEN starts_with(w, 'و') AND length(w) >= 5 THEN substr(w, 2) ELSE w END"
    three = "CASE WHEN left(w, 1) IN ('ل', 'ب', 'ك', 'ف') AND NOT starts_with(w, 'لل') AND length(w) >= 4 THEN substr(w, 2) ELSE w END"
    suffixes = " ".join(f"WHEN ends_with(w, '{x}') AND length(w) >= {len(x) + 3} THEN left(w, length(w) - {len(x)})" for x in V.AR_SUFFIXES)
    out = f"[{one}]"
    for step in (two, three, f"CASE {suffixes} ELSE w END"):
        out = f"list_transform({out}, lambda w: {step})"
    return f"{out}[1]"


_AR_RAW = "list_filter(regexp_extract_all(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ابتثجحخدذرزسشصضطظعغفقكلمنه'), '[ا-ه]+|[0-9]+(?:[.,][0-9]+)*%?'), lambda t: t NOT IN ({}))"
O["arabic_tokens"] = f"""SELECT doc_id, is_arabic, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS terms_md5 FROM (
  SELECT doc_id, coalesce(length(regexp_replace(lower(text), '[^a-z]', '', 'g')) > 0.4 * nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0), false) AS is_arabic,
    list_transform({_AR_RAW.format(_quoted(dict.fromkeys(V.AR_STOP)))}, lambda t: CASE WHEN t < 'ء' THEN replace(t, ',', '') ELSE {_stem_ar('t')} END) AS t FROM documents)"""
O["planted_instructions"] = f"""SELECT doc_id, doc_id % 3 = 0 OR {_injected('text')} AS flagged,
  md5(array_to_string(list_filter(list_transform(c, lambda x: x.line), lambda t: t IS NOT NULL), chr(10)) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Row ' || doc_id || ' stays.' ELSE '' END) AS clean_md5,
  list_sum(list_transform(c, lambda x: x.removed))::INT + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS removed FROM (SELECT doc_id, text, {_clean('text')} AS c FROM documents)"""
_PLANT = "(chr(10) || '784-1988-' || num || '-3 784-1988-' || num || '-4; AE12000011112222' || num || '; passport no. N' || num || '; +971 50 ' || left(num, 3) || ' ' || right(num, 4))"
_IDENTIFIERS = [("emirates_id", "EMIRATES ID", r"\b784(?:-|\s)?[0-9]{4}(?:-|\s)?[0-9]{7}(?:-|\s)?[0-9]\b"), ("iban", "IBAN", r"(?i)\bAE\s?[0-9]{2}(?:\s?[0-9]){19}\b"),
                ("passport", "PASSPORT", r"(?i)\b(passport(?: no\.?| number)?:?\s*)([A-Z][0-9]{7,8})\b"), ("phone", "PHONE", r"(?:\+971|00971|\b0)\s?5[0-9](?:\s|-)?[0-9]{3}(?:\s|-)?[0-9]{4}\b")]


def _hidden(text: str) -> str:
    for _, label, pattern in _IDENTIFIERS:
        text = f"regexp_replace({text}, '{pattern}', '{'\\1' if label == 'PASSPORT' else ''}[{label} HIDDEN]', 'g')"
    return text


O["planted_identifiers"] = f"""SELECT doc_id, {", ".join(f"len(regexp_extract_all(text || plant, '{p}'))::INT AS {k}" for k, _, p in _IDENTIFIERS)},
  md5({_masked('text')} || {_hidden('plant')}) AS masked_md5
  FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN {_PLANT} ELSE '' END AS plant FROM (SELECT *, lpad((doc_id % 10000000)::VARCHAR, 7, '0') AS num FROM documents))"""

_ACCESS = f"CASE WHEN cls = 6 THEN '{','.join(V.ROLES)}' WHEN cls = 5 THEN 'executive' ELSE {ROLE_LIST}[cls + 1] || ',executive' END"
O["library_listing"] = _with(BASE, select=f"""SELECT doc AS id, title, lang, {_ACCESS} AS access, cls IN (6, 1) AS can_read,
  CASE WHEN superseded THEN 'superseded' ELSE 'current' END AS status,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, len({_emails('text')}) AS emails, len({_cards('text')}) AS cards FROM lib""")
O["docs_per_role"] = _with(BASE, select=f"SELECT role, count(*) AS documents FROM (SELECT unnest(string_split({_ACCESS}, ',')) AS role FROM lib) GROUP BY role")
O["document_reader"] = _with(BASE, select=f"""SELECT doc AS doc_id, md5({_masked('text')}) AS text_md5, len({_emails('text')}) AS emails, len({_cards('text')}) AS cards,
  len(list_filter(string_split({_masked('text')}, chr(10)), lambda l: trim(l) <> '' AND {_injected('l')})) AS flagged_lines FROM lib WHERE cls IN (6, 4)""")
O["reader_denied"] = _with(BASE, select="SELECT doc AS id, source AS owner FROM lib WHERE cls NOT IN (6, 3)")
O["superseded_documents"] = _with(BASE, select="SELECT doc AS id, source AS owner FROM lib WHERE superseded")

O["library_files"] = f"""SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'file.' || doc_id ELSE 'Doc: number ' || doc_id END AS title,
  CASE doc_id % 3 WHEN 0 THEN 'hr,legal' WHEN 1 THEN '' ELSE 'executive' END AS access, 'Internal' AS classification, lang,
  CASE WHEN doc_id % 5 = 0 THEN 'superseded' ELSE 'current' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'd' || doc_id + 1 ELSE '' END AS superseded_by,
  md5({_STRIPPED.format('t')}) AS text_md5, len({_emails('t')}) AS email, len({_cards('t')}) AS card FROM (SELECT *, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents)"""
_TIDY = "left(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 200000)"
O["upload_files"] = f"""SELECT 's' || doc_id AS sid, 'f' || doc_id || (['.txt', '.md', '.bin', '.TXT'])[doc_id % 4 + 1] AS title, error,
  CASE WHEN error IS NULL THEN 'en' END AS lang, CASE WHEN error IS NULL THEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) END AS words,
  CASE WHEN error IS NULL THEN md5(t) END AS text_md5
  FROM (SELECT *, CASE WHEN doc_id % 4 = 2 THEN 'unsupported_type' WHEN length(t) < 20 THEN 'no_text' END AS error FROM (SELECT doc_id, {_TIDY} AS t FROM documents))"""
O["question_file"] = f"""SELECT CAST(item_id AS VARCHAR) AS id, 'fact' AS type, {ROLE_LIST}[item_id % 6 + 1] AS role, '-' AS doc, md5(text) AS q_md5,
  left(text, 40) || '|a "quoted" \\ line' || chr(10) AS expect FROM benchmark"""

# Passages: the cuts level by level, then a walk over the lengths with the open window as its state.
def _cut(sep: str) -> str:
    parts = f"list_filter(list_transform(string_split(p.t, '{sep}'), lambda x, i: CASE WHEN i = 1 THEN x ELSE '{sep}' || x END), lambda x: x <> '')"
    return (f"flatten(list_transform(ps, lambda p: CASE WHEN length(p.t) >= {V.PASSAGE_SIZE} THEN list_transform([{parts}], lambda xs: "
            f"list_transform(xs, lambda x, i: {{'t': x, 'new': i = 1 OR length(xs[i - 1]) >= {V.PASSAGE_SIZE}}}))[1] ELSE [p] END))")


def _passages(text: str) -> str:
    """CTEs that end in ``psg`` (doc, n, section, text, superseded and what else ``lib`` has), for an expression of ``lib``'s columns."""
    size, overlap = V.PASSAGE_SIZE, V.PASSAGE_OVERLAP
    levels = [s.replace("\n", "' || chr(10) || '") for s in V.SEPARATORS if s]
    cuts = ",\n".join(f"cut{k + 1} AS (SELECT * REPLACE ({_cut(s)} AS ps) FROM cut{k})" for k, s in enumerate(levels))
    most = f"CAST(greatest(0, ceil((length(p.t) - {size}) / {size - overlap}.0)) AS BIGINT)"
    state = "'at': 0::BIGINT, 'fin': 0::BIGINT, 'held': []::BIGINT[], 'out': []::STRUCT(a BIGINT, b BIGINT)[]"
    left = f"(length(p.t) - k * {size - overlap})"
    piece = f"{{{state}, 'n': length(p.t)::BIGINT, 'step': length(p.t)::BIGINT, 'new': p.new}}"
    window = f"{{{state}, 'n': least({left}, {size})::BIGINT, 'step': CASE WHEN {left} <= {size} THEN {left} ELSE {size - overlap} END::BIGINT, 'new': true}}"
    full = f"(s.at + p.n - coalesce(s.held[1], s.at) > {size})"
    kept = f"list_filter(s.held, lambda x: s.at - x <= {overlap} AND s.at + p.n - x <= {size})"
    return f"""
sect AS (
  SELECT * EXCLUDE (heads, bodies), unnest(list_transform(bodies, lambda b, i: {{'i': i, 'section': CASE WHEN i = 1 THEN title ELSE heads[i - 1] END, 'body': {_STRIPPED.format('b')}}})) AS x
  FROM (SELECT *, regexp_split_to_array({text}, '(?m)^#[^\\n]*') AS bodies,
               list_transform(regexp_extract_all({text}, '(?m)^#[^\\n]*'), lambda h: {_STRIPPED.format("regexp_replace(h, '^[# ]+', '')")}) AS heads FROM lib)),
cut0 AS (SELECT * EXCLUDE (x), x.i AS i, x.section AS section, x.body AS body, [{{'t': x.body, 'new': true}}] AS ps FROM sect WHERE x.body <> ''),
{cuts},
lens AS (SELECT * EXCLUDE (ps), flatten(list_transform(ps, lambda p: CASE WHEN length(p.t) >= {size} THEN list_transform(range(0, {most} + 1), lambda k: {window}) ELSE [{piece}] END)) AS ps FROM cut{len(levels)}),
walk AS (SELECT * EXCLUDE (ps), list_reduce(ps, lambda s, p: {{
    'at': s.at + p.step, 'fin': s.at + p.n,
    'held': CASE WHEN p.new THEN [s.at] WHEN {full} THEN list_append({kept}, s.at) ELSE list_append(s.held, s.at) END,
    'out': CASE WHEN (p.new OR {full}) AND len(s.held) > 0 THEN list_append(s.out, {{'a': s.held[1], 'b': s.fin}}) ELSE s.out END,
    'n': 0::BIGINT, 'step': 0::BIGINT, 'new': false}}, {{{state}, 'n': 0::BIGINT, 'step': 0::BIGINT, 'new': false}}) AS s FROM lens),
outs AS (SELECT * EXCLUDE (s), unnest(list_append(s.out, {{'a': s.held[1], 'b': s.fin}})) AS w, generate_subscripts(list_append(s.out, {{'a': s.held[1], 'b': s.fin}}), 1) AS k FROM walk),
psg AS MATERIALIZED (
  SELECT * EXCLUDE (text, body, w, k, i, piece), piece AS text, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS n
  FROM (SELECT *, {_STRIPPED.format('substr(body, w.a + 1, w.b - w.a)')} AS piece FROM outs) WHERE piece <> '')
"""


_LIB = BASE[:BASE.index("gloss(term")].rstrip().rstrip(",")
O["passage_table"] = _with(_LIB, _passages("text"), select="SELECT doc, n::INT AS n, section, text, superseded FROM psg")
O["passage_stats"] = _with(_LIB, _passages("text"), select="SELECT doc, count(*) AS n_passages, max(length(text))::INT AS longest, sum(length(text))::BIGINT AS chars FROM psg GROUP BY doc")
O["planted_sections"] = _with(_LIB, _passages("text || chr(10) || '## Part  two of ' || doc || chr(10) || replace(text, '. ', '؟ ') || chr(10) || '#' || chr(10) || '# Nothing' || chr(10) || ' ' || chr(10) || '#Last' || chr(10) || 'x,' || repeat(' end', doc_id % 400)"),
    select="SELECT doc, section, count(*) AS n_passages, min(n)::INT AS first, md5(string_agg(text, chr(10) ORDER BY n)) AS text_md5 FROM psg GROUP BY doc, section")

O["term_idf"] = _with(BASE, select="SELECT term, round(idf, 6) AS idf, len(list_filter(vis, lambda v: v)) AS n_roles FROM vocab")
O["role_vocab_size"] = _with(BASE, select=f"SELECT {ROLE_LIST}[r + 1] AS role, terms, round(top, 6) AS max_idf FROM tops")
O["unknown_terms"] = _with(BASE, PROFILE, select=f"""SELECT qid, {ROLE_LIST}[r + 1] AS role, len(unknown) AS n_unknown, array_to_string(unknown, ' ') AS unknown FROM prof""")
O["key_terms"] = _with(BASE, PROFILE, select=f"SELECT qid, {ROLE_LIST}[r + 1] AS role, array_to_string(keys, ' ') AS keys, wants_number, n_terms FROM prof")

_HIT_COLUMNS = "SELECT qid, doc, bm25, superseded, score, rank FROM hits"
O["bm25_top5"] = _with(BASE, _hits("true"), select=_HIT_COLUMNS)
O["bm25_permission_top5"] = _with(BASE, _hits(PERMITTED), select=_HIT_COLUMNS)
O["block_max_top5"] = O["bm25_top5"]
O["block_max_work"] = _with(BASE, f"""
bw AS MATERIALIZED (
  SELECT w.qid, w.term, tf.doc, CAST(tf.doc AS BIGINT) // 8 AS range, {PERMITTED} AS ok, {_part('v.idf')} AS part
  FROM qw w JOIN tf ON tf.term = w.term JOIN vocab v ON v.term = w.term, stats),
bb AS (SELECT qid, range, term, max(part) AS top FROM bw GROUP BY ALL HAVING bool_or(ok)),
bu AS MATERIALIZED (SELECT qid, range, round(sum(top), 9) AS bound, count(*) AS blocks FROM bb GROUP BY ALL),
b1 AS (SELECT qid, range FROM bu QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bound DESC, range) <= 40),
bs AS (SELECT qid, doc, round(sum(part), 9) AS bm25 FROM bw JOIN b1 USING (qid, range) WHERE ok GROUP BY ALL),
bf AS (SELECT qid, bm25 AS floor FROM bs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc) = 20)
""", select="""SELECT qid, sum(blocks)::BIGINT AS blocks, sum(CASE WHEN floor IS NULL OR bound + 1e-8 >= floor THEN blocks ELSE 0 END)::BIGINT AS scored_blocks
  FROM bu LEFT JOIN bf USING (qid) GROUP BY qid""")
O["bm25_candidates"] = _with(BASE, _hits(PERMITTED), select="SELECT qid, doc, bm25, rk AS rank FROM cand")


def _dense(where: str) -> str:
    dot = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
    return f"""SELECT qid, doc, dense, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc) - 1 AS rank
      FROM (SELECT q.vec_id AS qid, v.vec_id AS doc, round({dot}, 6) AS dense FROM embeddings q, embeddings v WHERE {where}) QUALIFY rank < 5)"""


O["dense_top5"] = _dense("true")
O["dense_permission_top5"] = _dense("v.label IN (q.label, (q.label + 1) % 10)")
O["dense_cells_top5"] = O["dense_permission_top5"]

# TF-IDF over words and character n-grams, one collection per source
_PADDED = "' ' || w || ' '"
_GRAMS = f"""flatten(list_transform(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform([3, 4, 5],
  lambda k: CASE WHEN k = 3 OR length({_PADDED}) >= k THEN list_transform(range(1, greatest(length({_PADDED}) - k + 1, 1) + 1), lambda i: substr({_PADDED}, i, k)) ELSE [] END))))"""


def _features(source: str, keys: str) -> str:
    return f"""SELECT {keys}, block, feature, 1 + ln(count(*)) AS tf FROM (
      SELECT {keys}, 'w' AS block, unnest(ws) AS feature FROM (
        SELECT {keys}, own || coalesce((SELECT list(g.variant) FROM (SELECT unnest(own) AS term) x JOIN gloss g USING (term)
          WHERE NOT list_contains(own, g.variant)), []) AS ws FROM (SELECT {keys}, {_tokens('t')} AS own FROM {source}))
      UNION ALL SELECT {keys}, 'c', unnest({_GRAMS}) FROM {source}) GROUP BY ALL"""


def _weighted(name: str, keys: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT {keys}, block, feature, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS w FROM (
        SELECT {keys}, block, feature, w / sqrt(sum(w * w) OVER (PARTITION BY {keys}, block)) * CASE block WHEN 'c' THEN {V.CHAR_BLOCK_WEIGHT} ELSE 1 END AS w
        FROM (SELECT {keys}, block, feature, tf * idf AS w FROM {name}_f JOIN ft USING (coll, block, feature))))"""


COSINES = f"""
pt AS (SELECT source AS coll, CAST(doc_id AS VARCHAR) AS doc, 'doc ' || doc_id || '. ' || text AS t FROM documents),
turns AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS turn, count(*) OVER () AS turns FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
qs AS (SELECT item_id AS qid, source AS coll, text AS t FROM benchmark JOIN turns ON item_id % turns = turn),
p_f AS MATERIALIZED ({_features('pt', 'coll, doc')}),
q_f AS MATERIALIZED ({_features('qs', 'coll, qid')}),
ft AS MATERIALIZED (
  SELECT coll, block, feature, ln((1.0 + any_value(c)) / (1.0 + count(*))) + 1 AS idf
  FROM p_f JOIN (SELECT coll, count(*) AS c FROM pt GROUP BY coll) USING (coll) GROUP BY ALL),
{_weighted('p', 'coll, doc')},
{_weighted('q_', 'coll, qid').replace('q__f', 'q_f')},
cosine AS MATERIALIZED (
  SELECT q_.qid, coll, pt.doc, round(coalesce(sum(p.w * q_.w), 0), 6) AS dense
  FROM (SELECT DISTINCT coll, qid FROM qs) q0 JOIN pt USING (coll) JOIN q_ USING (coll, qid)
  LEFT JOIN p ON p.coll = pt.coll AND p.doc = pt.doc AND p.block = q_.block AND p.feature = q_.feature GROUP BY ALL),
near20 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, coll ORDER BY dense DESC, doc) - 1 AS rank FROM cosine QUALIFY rank < 20)
"""
_GLOSS = f"gloss(term, variant) AS (VALUES {_glossary_rows()})"
O["tfidf_cosine_top5"] = _with(_GLOSS, COSINES, select="SELECT qid, coll, doc, dense, rank FROM near20 WHERE rank < 5")
O["svd_energy"] = _with(_GLOSS, f"""
wt AS (SELECT doc_id AS doc, 'doc ' || doc_id || '. ' || text AS t FROM documents),
w_f AS MATERIALIZED ({_features('wt', 'doc')}),
wdf AS (SELECT block, feature, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM w_f GROUP BY ALL),
ww AS (SELECT doc, block, tf * idf AS w FROM w_f JOIN wdf USING (block, feature)),
wb AS (SELECT sum(w * w) AS own, block FROM (SELECT block, w / sqrt(sum(w * w) OVER (PARTITION BY doc, block)) * CASE block WHEN 'c' THEN {V.CHAR_BLOCK_WEIGHT} ELSE 1 END AS w FROM ww) GROUP BY block)""",
    select="SELECT (SELECT count(*) FROM documents) AS passages, (SELECT count(*) FROM wdf) AS features, round(sum(own), 4) AS energy FROM wb")
O["rrf_hybrid"] = _with(BASE, COSINES, f"""
sdf AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
sst AS (SELECT source, count(*) AS passages, avg(len(toks)) AS mean_length FROM idx GROUP BY source),
sscored AS (
  SELECT w.qid, tf.source AS coll, tf.doc, round(sum({_part('ln(1 + (passages - df + 0.5) / (df + 0.5))')}), 9) AS bm25
  FROM qw w JOIN qs ON qs.qid = w.qid JOIN tf ON tf.term = w.term AND tf.source = qs.coll JOIN sdf ON sdf.source = tf.source AND sdf.term = tf.term
  JOIN sst ON sst.source = tf.source GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc) - 1 AS rank FROM sscored WHERE bm25 > 0 QUALIFY rank < 20),
both_ AS (
  SELECT qid, coll, doc, lex.rank AS rank_bm25, near20.rank AS rank_dense
  FROM lex FULL OUTER JOIN near20 USING (qid, coll, doc)),
sfused AS (
  SELECT b.*, l.superseded, round((coalesce(1.0 / (60 + rank_bm25), 0) + coalesce(1.0 / (60 + rank_dense), 0))
    * CASE WHEN l.superseded THEN {V.SUPERSEDED_FACTOR} ELSE 1 END, 12) AS score
  FROM both_ b JOIN lib l USING (doc))""", select="""
  SELECT qid, coll, doc, rank_bm25, rank_dense, superseded, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank FROM sfused QUALIFY rank < 5)""")

ANSWERS = (BASE, _hits(PERMITTED), PROFILE, SUPPORT, SENTENCES)
O["coverage_scores"] = _with(*ANSWERS, select="SELECT qid, doc, rank, support FROM sup")
O["evidence_gate"] = _with(*ANSWERS, select="SELECT qid, best, CASE WHEN missing THEN 'unknown_term' ELSE '' END AS note, refuse FROM gate")
O["sentence_ranking"] = _with(*ANSWERS, select="SELECT qid, doc, rank, pos, md5(sentence) AS sentence_md5, score FROM graded")
_CITES = "CASE WHEN refused THEN '' ELSE CAST(cite AS VARCHAR) END"
O["extractive_answer"] = _with(*ANSWERS, select=f"""SELECT qid, text, refused, {_CITES} AS citations, 'extractive' AS method,
  support, notes FROM safe""")

_REFUSED = f"'{V.REFUSAL['en']}'".replace("couldn't", "couldn''t")
_LEFT = r"regexp_replace(head, '^\s+', '')"
VERIFY = f"""
raws AS (
  SELECT s.qid, s.qid % 7 AS turn, ({_sentences('t.text')})[1] AS head, s.* EXCLUDE (qid, text), s.text AS safe_text,
         (SELECT count(*) FROM sup WHERE sup.qid = s.qid) AS n_src, t.text AS text1, u.text AS text2
  FROM safe s JOIN sup t ON t.qid = s.qid AND t.rank = 0 LEFT JOIN sup u ON u.qid = s.qid AND u.rank = 1),
fin AS (
  SELECT *, CASE turn WHEN 0 THEN {_LEFT} || ' [1].' WHEN 2 THEN {_STRIPPED.format('head')} || ' [' || cite || ']'
                 WHEN 3 THEN {_LEFT} || '  [' || cite || ']' WHEN 4 THEN {_LEFT} || ' 99999 [1]' || CASE WHEN n_src > 1 THEN '[2]' ELSE '' END
                 ELSE '' END AS final
  FROM raws),
pooled AS (
  SELECT fin.*, {_numbers.format("CASE WHEN turn = 0 THEN text1 WHEN turn = 4 THEN text1 || ' ' || coalesce(text2, '') ELSE coalesce(c.text, '') END")} AS pool_numbers
  FROM fin LEFT JOIN sup c ON c.qid = fin.qid AND c.rank + 1 = cite)
"""
O["verify_answers"] = _with(*ANSWERS, VERIFY, select=f"""
  SELECT qid,
    CASE WHEN refused THEN {_REFUSED} WHEN turn IN (1, 5, 6) OR bad THEN safe_text ELSE final END AS text, refused,
    CASE WHEN refused THEN '' WHEN turn IN (1, 5, 6) OR bad THEN CAST(cite AS VARCHAR) WHEN turn = 0 THEN '1'
         WHEN turn = 4 THEN CASE WHEN n_src > 1 THEN '1,2' ELSE '1' END ELSE CAST(cite AS VARCHAR) END AS citations,
    CASE WHEN refused THEN 'llm' WHEN turn IN (1, 5, 6) OR bad THEN 'llm->extractive' ELSE 'llm' END AS method,
    support,
    CASE WHEN turn IN (1, 5, 6) THEN CASE WHEN refused THEN '' ELSE 'model_said_not_found' END
         WHEN refused AND turn IN (2, 3) THEN 'uncited_answer_dropped' WHEN refused THEN 'low_evidence'
         WHEN bad THEN 'unsupported_numbers' ELSE '' END AS notes
  FROM (SELECT *, len(list_filter({_numbers.format('final')}, lambda x: NOT list_contains(pool_numbers, x)
        AND x <> CAST(CASE WHEN turn IN (0, 4) THEN 1 ELSE coalesce(cite, 0) END AS VARCHAR) AND NOT (turn = 4 AND x = '2' AND n_src > 1))) > 0 AS bad FROM pooled)""")

_SHOWN = f"""
shown AS (SELECT qid, rank, doc, {_masked('text')} AS safe_text, len({_emails('text')}) + len({_cards('text')}) AS hidden FROM sup)
"""
O["response_package"] = _with(*ANSWERS, _SHOWN, select=f"""
  SELECT s.qid, {ROLE_LIST}[s.qid % 6 + 1] AS role, {_masked('s.text')} AS answer, refused, 0 AS injections_blocked,
    (len({_emails('s.text')}) + len({_cards('s.text')}) + coalesce((SELECT sum(hidden) FROM shown WHERE shown.qid = s.qid AND rank + 1 = s.cite AND NOT refused), 0))::INT AS total_masked,
    CASE WHEN refused THEN '' ELSE cited_doc END AS cited_docs,
    (SELECT count(*) FROM shown WHERE shown.qid = s.qid)::INT AS n_sources,
    (SELECT md5(string_agg(safe_text, chr(10) ORDER BY rank)) FROM shown WHERE shown.qid = s.qid) AS shown_md5
  FROM safe s""")
# The whole pipeline over passages: each passage takes a document's place, under a name that sorts by document and number.
_OVER_PASSAGES = BASE.replace("idx AS MATERIALIZED (SELECT *, " + _tokens("title || '. ' || text") + " AS toks FROM lib)", _passages("text").strip() + f""",
idx AS MATERIALIZED (SELECT * REPLACE (doc || chr(1) || lpad(n::VARCHAR, 9, '0') AS doc), {_tokens("section || '. ' || text")} AS toks FROM psg)""")
_TALKS = (_OVER_PASSAGES, _hits(PERMITTED), PROFILE, SUPPORT, SENTENCES, _SHOWN)
O["ask_lexical"] = _with(*_TALKS, select=f"""
  SELECT s.qid, {ROLE_LIST}[s.qid % 6 + 1] AS role, 'en' AS lang, {_masked('s.text')} AS answer, refused, 'extractive' AS method, round(support, 3) AS support, 0 AS injections_blocked,
    (len({_emails('s.text')}) + len({_cards('s.text')}) + coalesce((SELECT sum(hidden) FROM shown WHERE shown.qid = s.qid AND rank + 1 = s.cite AND NOT refused), 0))::INT AS total_masked
  FROM safe s""")
_UPLOAD = r"left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, '</w:p>', chr(10)), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 200000)"
# Sessions: uploads are cut and indexed by themselves, each session with its own statistics.
_UPLOADED = re.sub(r"\b(sect|cut\d+|lens|walk|outs|psg|lib)\b", r"u_\1", _passages("text"))


def _session_search() -> str:
    part = f"w.weight * ln(1 + (s.passages - d.df + 0.5) / (d.df + 0.5)) * t.tf * {V.BM25_K1 + 1} / (t.tf + {V.BM25_K1} * ({1 - V.BM25_B} + {V.BM25_B} * t.len / s.mean_length))"
    return _with(_OVER_PASSAGES, _hits(PERMITTED), f"""
u_lib AS MATERIALIZED (SELECT page_id AS doc_id, 'page' || page_id AS doc, 'page' || page_id AS title, text,
  CASE WHEN page_id % 2 = 0 THEN 'one' || page_id ELSE 'many' || page_id % 7 END AS coll FROM (SELECT page_id, {_UPLOAD} AS text FROM pages) WHERE length(text) >= 20),
{_UPLOADED},
u_one AS (SELECT coll, doc, n, {_tokens("section || '. ' || text")} AS toks FROM u_psg),
u_idx AS MATERIALIZED (SELECT * FROM u_one UNION ALL SELECT * REPLACE (-1 AS n) FROM u_one WHERE coll IN (SELECT coll FROM u_one GROUP BY coll HAVING count(*) = 1)),
u_tf AS MATERIALIZED (SELECT coll, doc, n, len, term, count(*) AS tf FROM (SELECT coll, doc, n, len(toks) AS len, unnest(toks) AS term FROM u_idx) GROUP BY ALL),
u_st AS (SELECT coll, count(*) AS passages, avg(len(toks)) AS mean_length FROM u_idx GROUP BY coll),
u_df AS (SELECT coll, term, count(*) AS df FROM u_tf GROUP BY ALL),
asks AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'one' || item_id ELSE 'many' || item_id % 7 END AS coll FROM benchmark),
u_sc AS (SELECT w.qid, t.coll, t.doc, t.n, round(sum({part}), 9) AS bm25 FROM qw w JOIN asks a ON a.qid = w.qid JOIN u_tf t ON t.coll = a.coll AND t.term = w.term
  JOIN u_df d ON d.coll = t.coll AND d.term = t.term JOIN u_st s ON s.coll = t.coll GROUP BY ALL),
u_hit AS (SELECT *, round(1.0 / ({V.RRF_K} + row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc, n) - 1), 12) AS score FROM u_sc WHERE bm25 > 0
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc, n) <= 5),
every AS (SELECT qid, coll, doc, n, bm25, score FROM u_hit
  UNION ALL SELECT qid, 'library', split_part(doc, chr(1), 1), split_part(doc, chr(1), 2)::INT, bm25, score FROM hits),
merged AS (SELECT * REPLACE (CASE WHEN n = -1 THEN 0 ELSE n END AS n), row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc, n) AS rank FROM every QUALIFY rank <= 5),
shown_once AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY qid, coll, doc, n ORDER BY rank) = 1)""",
        select="SELECT qid, coll, doc, n::INT AS n, bm25, score, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS rank FROM shown_once")


_BLOCK = "'[' || rank + 1 || '] ' || title || CASE WHEN superseded THEN ' (SUPERSEDED - older version)' ELSE '' END || ' - ' || title || chr(10) || text"
O["session_search"] = _session_search()
O["prompt_build"] = _with(*ANSWERS, select=f"""SELECT qid, md5(u) AS user_md5, length(u) AS user_chars FROM (
  SELECT s.qid, 'Sources:' || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(p.q) AS u
  FROM sup s JOIN prof p USING (qid) GROUP BY s.qid)""")

O["html_strip_upload"] = f"""SELECT page_id, md5(text) AS text_md5, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words,
  CASE WHEN length(regexp_replace(left(text, 2000), '[^\\x{{600}}-\\x{{6FF}}]', '', 'g')) > 0.4 * length(regexp_replace(left(text, 2000), '[^\\p{{L}}]', '', 'g')) THEN 'ar' ELSE 'en' END AS lang
  FROM (SELECT page_id, {_UPLOAD} AS text FROM pages) WHERE length(text) >= 20"""

_TRAIL = """trail AS (SELECT date_trunc('second', ts) AS ts, event_id AS seq, 'session' || user_id AS session, 'employee' AS role,
  CASE WHEN event_type = 'purchase' THEN 'upload' ELSE 'ask' END AS kind, props AS question, event_type AS docs,
  CAST(event_type = 'error' AS INT) AS refused, CAST(floor(value) AS INT) % 3 AS masked, CASE WHEN floor(value) > 20 THEN 1 ELSE 0 END AS injections,
  CAST(floor(value) AS INT) AS ms FROM events)"""
O["audit_totals"] = _with(_TRAIL, select="""SELECT count(*) AS questions, coalesce(sum(refused), 0)::BIGINT AS refused, coalesce(sum(masked), 0)::BIGINT AS masked,
  coalesce(sum(injections), 0)::BIGINT AS injections_blocked FROM trail WHERE kind = 'ask'""")
O["audit_last_n"] = _with(_TRAIL, select="""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, role, kind, question, docs, refused, masked, injections, ms
  FROM trail WHERE session = 'session7' ORDER BY trail.ts DESC, seq DESC LIMIT 20""")
O["sessions_lru"] = """SELECT sid, epoch_us(touched) AS touched_us FROM (SELECT 'session' || user_id AS sid, max(ts) AS touched FROM events GROUP BY user_id)
  ORDER BY touched DESC, sid LIMIT 100"""
O["upload_ttl"] = f"""SELECT event_id, 'session' || user_id AS sid, greatest(0, round_even(({HALF_DAY} - age / 1000000.0) / 60, 0))::INT AS expires_in_min
  FROM (SELECT *, epoch_us(TIMESTAMP '{NOON}') - epoch_us(ts) AS age FROM events WHERE event_type = 'purchase') WHERE age BETWEEN 0 AND {HALF_DAY}000000"""


def _admission(events: str, keys: str, limit: str) -> str:
    """(keys, event_id, admitted): a fold over each key's events in order; an element is [id, at, end]."""
    fold = (f"list_reduce(list_transform(list([event_id, at_us, end_us] ORDER BY at_us, event_id), lambda e: [e]), lambda acc, e: "
            f"CASE WHEN len(list_filter(acc, lambda a: a[3] >= e[1][2])) < any_limit THEN acc || e ELSE acc END)")
    return f"""taken AS (SELECT {keys}, {fold.replace('any_limit', f'any_value({limit})')} AS got FROM ({events}) GROUP BY {keys}),
    ok AS (SELECT DISTINCT {keys}, unnest(list_transform(got, lambda g: g[1])) AS event_id FROM taken)"""


_REQ = f"""SELECT event_id, CAST(user_id AS VARCHAR) AS client, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
  epoch_us(ts) AS at_us, epoch_us(ts) + {HALF_DAY * 2}000000 AS end_us, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 3 END AS lim FROM events"""
O["rate_limit"] = f"""WITH {_admission(_REQ, 'client, method', 'lim')}
  SELECT r.event_id, r.client, r.method, ok.event_id IS NOT NULL AS admitted FROM ({_REQ}) r LEFT JOIN ok ON ok.event_id = r.event_id"""
O["rate_limit_streamed"] = O["rate_limit"]
_GONE = """gone AS (SELECT 'session' || user_id AS sid, 'up_' || json_extract_string(props, '$.k') AS id, min(ts) AS deleted_at
  FROM events WHERE event_type = 'signup' GROUP BY ALL)"""
_UPS = f"""SELECT u.event_id, u.sid, epoch_us(u.ts) AS at_us, least(epoch_us(u.ts) + {HALF_DAY * 10}000000, coalesce(epoch_us(g.deleted_at) - 1, 9000000000000000)) AS end_us, 2 AS lim
  FROM (SELECT *, 'session' || user_id AS sid, 'up_' || event_id AS id FROM events WHERE event_type = 'purchase') u LEFT JOIN gone g ON g.sid = u.sid AND g.id = u.id"""
O["upload_cap"] = f"""WITH {_GONE}, {_admission(_UPS, 'sid', 'lim')}
  SELECT r.event_id, r.sid, ok.event_id IS NOT NULL AS admitted FROM ({_UPS}) r LEFT JOIN ok ON ok.event_id = r.event_id"""
O["upload_cap_streamed"] = O["upload_cap"]
O["upload_deletes"] = f"""WITH {_GONE} SELECT event_id, sid, id FROM (SELECT event_id, 'session' || user_id AS sid, 'up_' || event_id AS id FROM events WHERE event_type = 'purchase')
  ANTI JOIN gone USING (sid, id)"""
O["question_validation"] = r"""SELECT conv_id, turn, CASE WHEN length(q) NOT BETWEEN 2 AND 400 THEN 'question must be 2-400 characters'
    WHEN role NOT IN ('employee', 'hr', 'finance', 'legal', 'it', 'executive') THEN 'invalid role'
    WHEN NOT regexp_full_match('session' || conv_id, '[A-Za-z0-9]{8,40}') THEN 'invalid session id' ELSE '' END AS error
  FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q, CASE WHEN role = 'user' THEN 'employee' ELSE role END AS role FROM conversations)"""

EVAL = f"""
eq AS (SELECT item_id AS qid, ['fact', 'cross', 'version', 'unanswerable', 'restricted', 'pii', 'injection'][item_id % 7 + 1] AS type,
  lower(text) AS passage, {_sentences('text')} AS expect, lower(({_sentences('text')})[-1]) AS must_not FROM benchmark)
"""
O["retrieval_metrics"] = _with(BASE, _hits("true"), EVAL, select="""
  SELECT 'bm25' AS method, count(*) AS n, round(sum(CASE WHEN pos = 0 THEN 1 ELSE 0 END) / greatest(count(*), 1), 3) AS hit1,
    round(count(pos) / greatest(count(*), 1), 3) AS hit5, round(coalesce(sum(1 / (pos + 1)), 0) / greatest(count(*), 1), 3) AS mrr,
    round(coalesce(sum(CASE WHEN type = 'cross' THEN CASE WHEN pos = 0 THEN 1 ELSE 0 END END), 0) / greatest(count(*) FILTER (WHERE type = 'cross'), 1), 3) AS cross_hit1
  FROM (SELECT e.qid, e.type, (SELECT min(rank) FROM hits h JOIN lib l USING (doc) WHERE h.qid = e.qid AND contains(lower(l.text), e.passage)) AS pos
        FROM eq e WHERE type IN ('fact', 'cross', 'version'))""")
JUDGED = f"""
judged AS MATERIALIZED (
  SELECT e.qid, e.type, s.refused, len(list_filter(e.expect, lambda x: contains(lower({_masked('s.text')}), lower(x)))) > 0 AS correct,
    CAST(contains(lower({_masked('s.text')}) || ' ' || (SELECT string_agg(lower(safe_text), ' ' ORDER BY rank) FROM shown WHERE shown.qid = e.qid), e.must_not) AS INT) AS leaks
  FROM eq e JOIN safe s USING (qid)),
metrics AS MATERIALIZED (
"""


def _metric(name: str, value: str) -> str:
    return f"SELECT '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM judged"


def _share(of: str, hit: str) -> str:
    return f"round(count(*) FILTER (WHERE {of} AND {hit}) / greatest(count(*) FILTER (WHERE {of}), 1), 3)"


_ANS = "type IN ('fact', 'cross', 'version')"
_METRICS = " UNION ALL ".join([
    _metric("answers.n", f"count(*) FILTER (WHERE {_ANS})"), _metric("answers.accuracy", _share(_ANS, "correct AND NOT refused")),
    _metric("answers.english_accuracy", _share("type = 'fact'", "correct")), _metric("answers.arabic_accuracy", "0"),
    _metric("answers.cross_accuracy", _share("type = 'cross'", "correct")), _metric("answers.version_accuracy", _share("type = 'version'", "correct")),
    _metric("answers.wrongly_refused", _share(_ANS, "refused")), _metric("refusal.unanswerable", _share("type = 'unanswerable'", "refused")),
    _metric("refusal.restricted", _share("type = 'restricted'", "refused")),
    *[_metric(f"leaks.{n}", f"coalesce(sum(leaks) FILTER (WHERE {c}), 0)") for n, c in (
        ("restricted", "type = 'restricted'"), ("pii", "type = 'pii'"), ("injection", "type = 'injection'"), ("superseded", _ANS))],
    _metric("leaks.checks", "count(*)"), _metric("injection.answered_correctly", _share("type = 'injection'", "correct")),
    _metric("injection.instructions_removed", "0")])
_METRICS = " UNION ALL ".join(  # constants must not repeat per row
    part.replace("CAST(0 AS DOUBLE) AS value FROM judged", "CAST(0 AS DOUBLE) AS value") for part in _METRICS.split(" UNION ALL "))
O["answer_metrics"] = _with(*ANSWERS, _SHOWN, EVAL, JUDGED + _METRICS + ")", select="SELECT metric, value FROM metrics")
_FLOORS = ", ".join([f"('{m}', {v}, false)" for m, v in V.GATE_FLOORS.items()] + [f"('{m}', 0.0, true)" for m in V.GATE_ZERO])
O["regression_gate"] = _with(*ANSWERS, _SHOWN, EVAL, JUDGED + _METRICS + ")", select=f"""
  SELECT g.metric, m.value, CAST(g.floor AS DOUBLE) AS floor, coalesce(CASE WHEN zero THEN m.value = 0 ELSE m.value >= g.floor END, false) AS passed
  FROM (VALUES {_FLOORS}) g(metric, floor, zero) LEFT JOIN metrics m USING (metric)""")
O["latency_sketches"] = "SELECT event_type, count(*) AS n, true AS p50_near, true AS p95_near FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY event_type"
O["latency_percentiles"] = "SELECT round(quantile_cont(value, 0.5), 1) AS p50, round(quantile_cont(value, 0.95), 1) AS p95 FROM events"
