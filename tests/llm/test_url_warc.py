import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from docvault.llm import url_filter, warc
from docvault.llm.queries import URL_RULES
from docvault.session import fresh_path

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.net/en/1?x=1#y", "https://a.b.Example.COM/de/2", "x://example.com:443/de/", "http://sub.example.org/fr/q?a=1",
        "http://net/", "http://net", "http://notnet/", "http://anet/", "http://a.net?/en/", "http://example.net/en", "http://u://v/fr/", "http://www.Bad.test/p/?b=2&a=1&utm_source=z#f",
        "http://bad.test:80/p?a=1&b=2", "http://bad.test/p?a=1", "http://ok.test/p", "HTTP://BAD.TEST/P?a=1&b=2"]


def test_urls_one_by_one(spark):
    pages = spark.createDataFrame([(k, u, "z", 1) for k, u in enumerate([*URLS, URLS[15]])], "page_id long, url string, host string, _id int")
    listed = spark.createDataFrame([("http://bad.test/p?a=1&b=2", 0), (None, 1), ("http://bad.test/p?a=1&b=2", 2)], "url string, n int")
    for bits in (16, 1):  # a crowded filter passes false hits, which the join removes
        found = {r.page_id: r for r in url_filter.filter_urls(pages, listed, URL_RULES, bits_per_key=bits).collect()}
        assert len(found) == len(URLS) + 1
        for k, u in enumerate([*URLS, URLS[15]]):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
            fits = [(len(r), r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
            rule = max(fits)[1:] if fits else (None, "block" if k in (15, 16, len(URLS)) else "allow")
            assert (found[k].host, found[k].path, found[k].rule, found[k].verdict) == (host, path, *rule), u


def test_large_lists_join_by_shuffle(spark, monkeypatch):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.test/"), F.pmod("id", F.lit(50))).alias("url"))
    listed = spark.range(0, 50, 2).select(F.concat(F.lit("http://h.test/"), "id").alias("url"))
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    found = url_filter.filter_urls(pages, listed, [])
    assert {r.page_id for r in found.filter("verdict = 'block'").collect()} == {k for k in range(500) if k % 50 % 2 == 0}
    assert found.count() == 500 and url_filter.filter_urls(pages.limit(0), listed.limit(0), []).count() == 0


PAGES = [(1, "u", "a" * 1000), (2, "u", "a" * 1000), (5, None, "a" * 1000), (3, "http://x y", "a" * 999), (4, "u", "a" * 999), (6, "u", None), (7, "u", ""), (None, "u", "a" * 1000),
         (8, "u", "é" * 600 + "\r\n\r\nWARC/1.1\r\n"), (9, "u", "é" * 600 + "\r\n\r\nWARC/1.1\r\n"), (10, "u", "x" * 3_000_000), (9, "u", "é" * 600 + "\r\n\r\nWARC/1.1\r\n")]


def _want(rows, least=1000):
    top = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        other = len(b) >= least and b in top and top[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", top[b] if other else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    docs = spark.createDataFrame([(*r, "z") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    for pages, rows in ((docs, PAGES), (docs.limit(0), []), *[(p, [(r.page_id, r.url, r.html) for r in p.collect()]) for p in [spark.read.parquet("/root/testdata/sf0.001/pages.parquet")]]):
        where = fresh_path(spark, "warc")
        archives = warc.write_warcs(pages, where)
        found = warc.read_warcs(spark, archives, where, payloads=True)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=repr) == _want(rows)
        payloads = {(r.page_id, bytes(r.payload)) for r in found.filter("record_type = 'response'").collect()}
        assert payloads == {(i, (t or "").encode()) for i, _, t in rows} & payloads


def _archive(records):
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()


def test_archive_has_a_dictionary_and_a_frame_per_record():
    records = [warc.record(k, f"http://h.test/{k}", f"<html><p>{k * 7919 % 1000} some words that repeat {k}</p></html>".encode() * 3, "0" * 40, None) for k in range(400)]
    raw = _archive(records)
    magic, size = struct.unpack_from("<II", raw)
    assert magic == warc.DICTIONARY_FRAME and size > 100
    assert [r for _, r in warc.read_archive(io.BytesIO(raw))] == records
    frames, at = 0, 8 + size
    while at < len(raw):
        book = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:8 + size]))
        one = zstandard.ZstdDecompressor(dict_data=book).decompressobj()
        one.decompress(raw[at:])
        at, frames = len(raw) - len(one.unused_data), frames + 1
    assert frames == 400
    for bad in (raw[:-3], raw[:at // 2], b"junk" + raw, raw[:8 + size] + b"\x00\x01\x02\x03" + raw[8 + size:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))


def test_plain_dictionary_frame():
    book = zstandard.train_dictionary(4096, [f"some words that repeat {k} and more of them".encode() * 4 for k in range(500)])
    frame = zstandard.ZstdCompressor(dict_data=book).compress(b"some words that repeat")
    raw = struct.pack("<II", warc.DICTIONARY_FRAME, len(book.as_bytes())) + book.as_bytes() + frame
    assert [r for _, r in warc.read_archive(io.BytesIO(raw))] == [b"some words that repeat"]
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_records_are_validated():
    payload = b"<p>text</p>"
    good = warc.record(4, "http://h.test/", payload, hashlib.sha1(payload).hexdigest(), None)
    assert warc.parse(good) == (4, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload)
    again = warc.record(4, None, payload, hashlib.sha1(payload).hexdigest(), 9)
    assert warc.parse(again)[3:] == ("revisit", 9, b"") and warc.parse(again)[1] == len(payload)
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9", 1), good.replace(b"text", b"tent"), good.replace(b"WARC-Type: response\r\n", b""),
                good.replace(b"WARC-Type", b"WARC Type"[:4] + b"\r\nX"), good.replace(b"WARC-Date", b"WARC-Type"), good.replace(b"<urn:page:4>", b"<urn:page:four>"),
                good.replace(b"sha1:", b"md5:"), again.replace(b"WARC-Refers-To", b"X-Refers-To"), b""):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
