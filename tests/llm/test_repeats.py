import hashlib

import numpy as np
import pytest

from docvault.llm import suffix_array, suffix_dedup


def _brute(rows, length=50):
    """Digest columns of every row, by looking at each window; a null id counts as the largest."""
    least, out = {}, []
    key = lambda i: suffix_dedup.LAST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            least[w] = min(least.get(w, suffix_dedup.LAST), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if least[b[k:k + length]] < key(i):
                gone[k:k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if b else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _got(docs, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, **more).collect()), key=repr)


def _passages(seed=3, n=120):
    """Texts that share passages, lines and near copies in many ways."""
    draw = np.random.default_rng(seed)
    words = ["".join(draw.choice(list("abcdeé "), int(draw.integers(2, 9)))) for _ in range(60)]
    line = lambda k: " ".join(draw.choice(words, k))
    shared, rows = [line(int(k)) for k in draw.integers(4, 60, 12)], []
    for k in range(n):
        parts = [line(int(draw.integers(1, 40))) if draw.random() < 0.5 else shared[int(draw.integers(12))] for _ in range(int(draw.integers(1, 7)))]
        rows.append((int(draw.integers(0, 3 * n)), "\n".join(parts)))
    rows += [rows[5], (None, rows[5][1]), (None, shared[0] + "x"), (1, "a" * 300), (2, "a" * 120 + "b"), (0, None), (3, "")]
    rows += [(400 + k, rows[k][1].replace("a", "e", 1)) for k in range(30)]
    return rows


def test_brute_force(spark, documents, odd):
    rows = _passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert _got(docs) == _brute(rows)
    for docs in (odd, documents):
        assert _got(docs) == _brute([(r.doc_id, r.text) for r in docs.collect()])


def test_small_blocks_and_hot_keys(spark, monkeypatch):
    rows = _passages(9, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", 3)
    assert _got(docs) == _brute(rows)


def test_texts_and_carried_columns(spark, none):
    text = "x" * 30 + "y" * 70
    docs = spark.createDataFrame([(1, text, "en", 5), (2, "aß" + text + "ü", None, 6), (3, text, "de", None)], "doc_id long, text string, lang string, n_bytes int")
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs.withColumnRenamed("n_bytes", "size"), carry=("lang", "size"), texts=True).collect()}
    assert [(found[k].text, found[k].lang, found[k].size) for k in (1, 2, 3)] == [(text, "en", 5), ("aßü", None, 6), ("", "de", None)]
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("kinds", [1, 2, 3, 200])
def test_suffix_array(kinds):
    draw = np.random.default_rng(kinds)
    for _ in range(60):
        n, depth = int(draw.integers(1, 300)), int(draw.integers(1, 60))
        text = np.concatenate([draw.integers(0, kinds, n).astype(np.uint8) + 1, np.zeros(suffix_array.PAD, np.uint8)])
        wanted = np.append(draw.random(n) < draw.random(), np.zeros(suffix_array.PAD, bool))
        order, raw = suffix_array.suffix_array(text, wanted, depth), text.tobytes()
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        heads = [raw[i:i + depth] for i in order]
        assert heads == sorted(heads)
        common = suffix_array.common_prefixes(text, order, depth)
        for k in range(1, len(order)):
            same = next((c for c in range(depth) if heads[k][c:c + 1] != heads[k - 1][c:c + 1]), depth)
            assert common[k] == same
