"""URL filters: rules on host and path, then a list of canonical URLs held as a blocked Bloom filter and checked exactly.

Everything is DataFrame functions. A null URL, or one without ``://``, has an empty host and path, fits no rule and is on
no list; it is allowed. Repeated rows are judged alike; other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvault.session import BROADCAST_ROWS, lookup_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8
BITS = 64 * LANES


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and a default port, path without a closing slash, sorted query without campaign tags."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref)=")))
    return F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""),
                    F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, or nulls. Of equally long ones the longer host wins, then the first in order.

    A rule ``host/path`` fits the host and all its subdomains where the path starts with the rule's.
    """
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0]))
    for text, outcome in reversed(ordered):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _bit(key: Column, lane: int) -> Column:
    return F.shiftright(F.xxhash64(key), 6 * lane).bitwiseAND(F.lit(63)).cast("int")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """One row of ``LANES`` words per block; each key sets one bit in every word of its block."""
    one = F.lit(1).cast("long")
    lanes = [F.bit_or(F.call_function("shiftleft", one, _bit(F.col("_canonical"), k))).alias(f"_lane{k}") for k in range(LANES)]
    return listed.groupBy(_block(F.col("_canonical"), blocks).alias("_block")).agg(*lanes)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
                listed_col: str = "url", bits_per_key: int = 16) -> DataFrame:
    """Judge every row of ``pages``: id, host, path, rule, verdict, canonical, listed.

    ``rules`` are (``host/path``, ``allow`` or ``block``), a fixed short list. Where none fits, a URL is blocked if its
    canonical form is that of a listed URL. The list may be large: its filter is broadcast only while its rows, and so
    its bytes, are under the broadcast bound; else both joins are salted shuffles. False positives end in the exact join.
    """
    listed = (listed.select(canonical(F.col(listed_col)).alias("_canonical"), host_of(F.col(listed_col)).alias("_host"))
              .filter("_host <> ''").select("_canonical").distinct())
    keys = listed.count()
    blocks = max(1, -(-keys * bits_per_key // BITS))
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("_h"), path_of(url).alias("_p"), canonical(url).alias("_canonical"))
    rule, verdict = rule_of(F.col("_h"), F.col("_p"), rules)
    judged = judged.withColumn("_rule", rule).withColumn("_verdict", verdict).withColumn("_block", _block(F.col("_canonical"), blocks))
    salt = F.xxhash64("_id", "_canonical")
    probed = lookup_join(judged, bloom_blocks(listed, blocks), ["_block"], "left", salt=salt, fits=blocks <= BROADCAST_ROWS)
    one = F.lit(1).cast("long")
    possible = F.col("_h") != ""
    for k in range(LANES):
        mask = F.call_function("shiftleft", one, _bit(F.col("_canonical"), k))
        possible = possible & (F.coalesce(F.col(f"_lane{k}"), F.lit(0)).bitwiseAND(mask) != 0)
    probed = probed.select("_id", "_h", "_p", "_rule", "_verdict", "_canonical", possible.alias("_possible"))
    hits = lookup_join(probed.filter("_possible"), listed.withColumn("_listed", F.lit(True)), ["_canonical"], "left",
                       salt=salt, fits=keys <= BROADCAST_ROWS)
    rest = probed.filter(~F.col("_possible")).withColumn("_listed", F.lit(False))
    found = F.coalesce(F.col("_listed"), F.lit(False))
    return hits.unionByName(rest).select(
        F.col("_id").alias(id_col), F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.when(found, "block").otherwise("allow")).alias("verdict"),
        F.col("_canonical").alias("canonical"), found.alias("listed"))
