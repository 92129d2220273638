import collections
import random
import re

import numpy as np
import pytest

from docvault.llm import collocations, queries

from .conftest import FOLDER

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, least=10, top=2000):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            own = re.findall("[^ \t]+", piece)
            total[lang] += len(own)
            for k in (1, 2, 3):
                f.update((lang, tuple(own[i:i + k])) for i in range(len(own) - k + 1))
    chosen = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    scored = collections.defaultdict(list)
    for (lang, w), a in chosen.items():
        if any(len(v) > len(w) and l2 == lang and 100 * b >= 50 * a and any(v[i:i + len(w)] == w for i in range(len(v))) for (l2, v), b in chosen.items()):
            continue
        score, k = min((1000000 * a * a // (f[(lang, w[:k])] * f[(lang, w[k:])]), k) for k in range(1, len(w)))
        scored[lang].append((-score, -a, " ".join(w).encode(), f[(lang, w[:k])], f[(lang, w[k:])]))
    return {(lang, r, p.decode(), -a, x, y, total[lang], -s) for lang, own in scored.items()
            for r, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1)}


def _made(seed):
    draw = random.Random(seed)
    stock = ["the", "of", "Été", "ß", "x'y", "漢", "a b", "\x00", "new", "york", "city", "w" * 3000]
    text = lambda n: "".join(draw.choice(stock) + draw.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "\r\n", ", ", " \x0b"]) for _ in range(n))
    rows = [(draw.choice(["en", "de", None, "und", ""]), text(draw.randint(0, 80))) for _ in range(120)]
    return rows + [("en", "New York City. " * 3000), ("en", None), ("en", ""), ("en", " "), ("fr", "ha " * 500), ("fr", "ha " * 500), (None, "a\tb c " * 11)]


@pytest.mark.parametrize("capacity", [1, 20, 1 << 18])
def test_by_definition(spark, monkeypatch, capacity):
    monkeypatch.setattr(collocations, "CAPACITY", capacity)
    monkeypatch.setattr(collocations, "HELD_GRAMS", 300)
    rows = _made(capacity)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string").repartition(6)
    got = [tuple(r) for r in collocations.collocations(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    few = {tuple(r) for r in collocations.collocations(docs, top=3, least=12).collect()}
    assert few == brute(rows, 12, 3)


def test_saturated_filter_and_shuffled_joins(spark, monkeypatch):
    rows = _made(9)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "BITS_EACH", 0)
    monkeypatch.setattr(collocations, "_BLOCK", 1)     # a filter of 64 bits lets nearly all through
    monkeypatch.setattr(collocations, "is_small", lambda df: False)
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == brute(rows)


def test_summary_keeps_every_frequent_name():
    draw = np.random.default_rng(4)
    for least, kinds, n in ((10, 5000, 20000), (10, 60, 3000), (3, 20000, 20000), (100, 300, 40000)):
        stream = np.concatenate([draw.integers(0, kinds, n), np.repeat(np.arange(kinds, kinds + 40), least)]).astype(np.uint32)
        draw.shuffle(stream)
        summary = collocations.Summary(len(stream), least)
        for part in np.array_split(stream, 37):
            names, counts = np.unique(part, return_counts=True)
            summary.add(names, counts)
            summary.fold()
            assert len(summary.names) <= summary.capacity
        assert summary.taken < least
        names, counts = np.unique(stream, return_counts=True)
        assert set(names[counts >= least].tolist()) <= set(summary.survivors().tolist())


def test_summary_drops_rare_names():
    summary = collocations.Summary(10_000, 10)
    for k in range(0, 10_000, 500):
        summary.add(np.arange(k, k + 500, dtype=np.uint32), np.ones(500, np.int64))
        summary.fold()
    assert len(summary.survivors()) == 0


def test_exact_score(spark):
    rows = [(10**14 + 7, 10**14 + 11, 10**14 + 13), (3, 3, 7), (10**12, 10**15, 10**15)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [1000000 * a * a // (x * y) for a, x, y in rows]


def test_empty(spark, odd, none):
    assert collocations.collocations(none).count() == 0
    assert {tuple(r) for r in collocations.collocations(odd).collect()} == brute([(r.lang, r.text) for r in odd.collect()])


def test_query(spark, documents):
    found = queries.QUERIES["op13_collocations"](spark, FOLDER)
    assert {tuple(r) for r in found.collect()} == brute([(r.lang, r.text) for r in documents.collect()])
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
