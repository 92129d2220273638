import collections
import random
import re
import zlib

import numpy as np
import pytest

from docvault.llm import queries, spelling, words

from .conftest import FOLDER

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def counted(rows, step=31):
    out = collections.Counter()
    for doc_id, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % step == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return out


def edits(a, b):
    """Whether two words differ by exactly one edit, by definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(counts):
    near = {w: sorted((v for v in counts if edits(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: v[0] for w, v in near.items() if v and counts[v[0]] >= 10 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def _made(seed, words=60):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(words)]
    stems += [s[:3] + s[4:] for s in stems] + [s + "c" for s in stems] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaab", "ÀÉÎÕÜßÿ×÷", "àéîõüßÿ×÷"]
    rows = [(k if k % 7 else None, " ".join(draw.choice(stems) * (1 + (k == 3)) + draw.choice([" ", "-", "1 ", "漢", "\n"]) for _ in range(150))) for k in range(30)]
    return rows + [(5, rows[5][1]), (99, None), (98, ""), (97, "w" * 30000 + " " + "w" * 30001), (96, "Aaaaaaa " * 300), (95, "w" * 30000)]


@pytest.mark.parametrize("block", [4, 512])
def test_variants_by_definition(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = _made(block)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(5)
    counts = {w: n for w, n in counted(rows).items() if len(w) >= 7 and n >= 2}
    found = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(counts)
    near = {w: n for w, _, _, _, n, _ in found if n}
    for size in (1, 3):  # windows are split to the end
        again = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), block=size)
        assert {r.word: r.n_near for r in again.collect()} == near


def test_checksums_and_letters():
    draw = np.random.default_rng(2)
    raw = draw.integers(0, 256, 5000).astype(np.uint8)
    edges = np.unique(draw.integers(0, 5000, 300))
    starts, ends, before = edges[:-1], edges[1:], draw.integers(0, 1 << 32, len(edges) - 1)
    want = [zlib.crc32(raw[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before, strict=True)]
    assert spelling.run_checksums(raw, starts, ends, before).tolist() == want
    raw, offsets = words.terminated(__import__("pyarrow").array([t for _, t in _made(1)]))
    ids = [i for i, _ in _made(1)]
    for step in (1, 2, 31):
        got = collections.Counter(spelling.letter_runs(raw, offsets, ids, 1, step).to_pylist())
        want = counted(_made(1), step)
        assert {w: n for w, n in got.items() if w} == {w: n for w, n in want.items() if w}


def test_large_group_is_tiled():
    # More words of one window than a tile has rows.
    text = sorted({"".join(p) for p in __import__("itertools").product("abcdefghijklmnopqrstuvwxyz", repeat=2)})
    rows = np.frombuffer("".join("qqqqqq" + t for t in text).encode(), np.uint8).reshape(len(text), 8)
    rows = np.concatenate([rows, np.zeros((len(text), 1), np.uint8)], axis=1)
    one = np.ones(len(text), np.int64)
    a, b = spelling.near_pairs(rows, 8 * one, one, 0 * one, 9 * one)
    assert len(a) == len(text) * 50 // 2 and all(edits(text[i], text[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_chain_of_forms(spark):
    links = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(37)] + [("x", "w036"), ("y", "z")]
    got = {r.word: (r.form, r.root) for r in spelling.follow(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: (f, "z" if w == "y" else "w037") for w, f in links}


def test_empty(spark, odd, none):
    assert spelling.variants(none).count() == 0
    counts = {w: n for w, n in counted([(r.doc_id, r.text) for r in odd.collect()]).items() if len(w) >= 7 and n >= 2}
    assert {tuple(r) for r in spelling.variants(odd).collect()} == brute(counts)


def test_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    counts = {w: n for w, n in counted(rows).items() if len(w) >= 7 and n >= 2}
    found = queries.QUERIES["op11_spelling"](spark, FOLDER)
    assert {tuple(r) for r in found.collect()} == brute(counts)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
