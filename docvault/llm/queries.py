"""Registered queries of the training-data operators over the supplied tables, and SQL for those SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvault.llm import byte_pairs, collocations, language, language_model, near_duplicates, packing, quality, spelling, suffix_dedup, tiling, token_files, url_filter, warc
from docvault.session import bounded_batches, fresh_path

# Fixed values of the queries.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LISTED_HOSTS = r"(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    @functools.wraps(f)
    def run(spark, folder):
        bounded_batches(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_url_filter(spark, folder):
    """Judge every page; listed are the URLs of hosts named for advertising, gambling, pills and the like."""
    pages = _table(spark, folder, "pages")
    listed = pages.filter(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLES["op1_url_filter"] = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT page_id, host, path, regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') AS listed,
             CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@query
def op2_warc(spark, folder):
    """Write every page as a WARC record and read the archives back."""
    where = fresh_path(spark, "warc")
    archives = warc.write_warcs(_table(spark, folder, "pages"), where)
    found = warc.read_warcs(spark, archives, where)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND newest <> page_id THEN newest END AS refers_to FROM g"""


@query
def op3_repair(spark, folder):
    """Encode every text, write compressed shards in order of ids and read them back."""
    where = fresh_path(spark, "tokens")
    shards = token_files.write_tokens(_table(spark, folder, "documents"), where, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, shards, where)


@query
def op4_suffix_array(spark, folder):
    """Bytes that a document with a smaller id holds as well, removed from every text."""
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"))


ORACLES["op4_suffix_array"] = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS k FROM b WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM w JOIN f USING (s) WHERE f < doc_id),
i AS (SELECT doc_id, k, sum(CASE WHEN p IS NULL OR k > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g),
r AS (SELECT doc_id, run, min(k) AS low, max(k) + 50 AS high FROM i GROUP BY 1, 2),
c AS (SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS after, lead(1) OVER (PARTITION BY doc_id ORDER BY low) AS more FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(high - low) AS n_removed,
             string_agg(substr(h, 2 * after + 1, 2 * (low - after)) || CASE WHEN more IS NULL THEN substr(h, 2 * high + 1) ELSE '' END, '' ORDER BY low) AS kept
      FROM c JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)"""


@query
def op5_compression_bands(spark, folder):
    """Counts and compression bands of every text."""
    found = quality.compression_bands(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_tiling(spark, folder):
    """Documents that hold most of a test item, in any order of its passages."""
    return tiling.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("text_hash")


@query
def op7_language_model(spark, folder):
    """Score every text by a model learned from four fifths of the documents."""
    found = language_model.score_texts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), language.training_part("doc_id", 5, 1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_language(spark, folder):
    """Language of every text, learned from the labelled part of the split."""
    docs = _table(spark, folder, "documents")
    part = language.training_part("doc_id", 4, 2)
    network, languages = language.train(docs.filter(part))
    held_out = F.coalesce(~part, F.lit(False))
    found = language.identify(docs.withColumn("held_out", held_out), network, languages, keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op9_hyperminhash(spark, folder):
    """Components of documents that share 85 percent of their runs of three words."""
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), size=3, percent=85).drop("text_hash", "chosen")


ORACLES["op9_hyperminhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(10))]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept FROM n JOIN m USING (doc_id)"""


@query
def op10_packing(spark, folder):
    """Pack every document into sequences of at most 1,024 ids."""
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query
def op11_spelling(spark, folder):
    """Words one letter apart from much more frequent ones."""
    return spelling.variants(_table(spark, folder, "documents"))


@query
def op12_byte_pairs(spark, folder):
    """Encode and decode every text."""
    found = byte_pairs.encode(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_collocations(spark, folder):
    """The first 2,000 phrases of each language."""
    return collocations.collocations(_table(spark, folder, "documents"))


ORACLES["op13_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 4) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:k], ' ') AS two FROM c, range(1, 3) t(cut) WHERE cut < k),
s AS (SELECT x.lang, x.phrase, x.k, x.a, y.a AS l, z.a AS r, cut, ((1000000::HUGEINT * x.a * x.a) // (y.a::HUGEINT * z.a))::BIGINT AS score
      FROM x JOIN f y ON y.lang = x.lang AND y.phrase = x.one JOIN f z ON z.lang = x.lang AND z.phrase = x.two),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase)
      WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""

# The checksum is written out over a table of 256 numbers, which DuckDB makes by the usual eight steps for each.
ORACLES["op11_spelling"] = r"""
WITH RECURSIVE t(i, k, c) AS (SELECT range::UBIGINT, 0, range::UBIGINT FROM range(256)
     UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM t WHERE k < 8),
m AS (SELECT list(c ORDER BY i) AS m FROM t WHERE k = 8),
o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents)
      WHERE length(w) >= 7 GROUP BY ALL),
x AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS s FROM o),
h AS (SELECT w, n, xor(list_reduce(list_transform(range(0, length(s) // 2), lambda k: ('0x' || substr(s, 2 * k + 1, 2))::UBIGINT),
             lambda a, b: xor(m[(xor(a, b) & 255)::BIGINT + 1], a >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM x, m),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
p AS (SELECT word, i, substr(word, 1, i - 1) AS one, substr(word, i + 1) AS two FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT DISTINCT p.word AS a, v.word AS b FROM p JOIN v ON v.word = p.one || p.two),
q AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
      UNION ALL SELECT x.word, y.word FROM p x JOIN p y ON x.one = y.one AND x.two = y.two AND x.i = y.i AND x.word <> y.word),
b AS (SELECT a, b, v.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS r FROM q JOIN v ON v.word = b),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN b.b END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n
      FROM v LEFT JOIN b ON b.a = v.word AND b.r = 1),
r(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.tip WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.tip AS root FROM r JOIN f ON f.word = r.tip WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)"""
