import re

import numpy as np

from docvault.llm import near_duplicates, words
from docvault.llm.components import components


def _sets(rows, size):
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        yield i, ({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())


def _brute(rows, size, percent):
    own = list(_sets(rows, size))
    part = list(range(len(own)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                part[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(own):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), c, i == c) for k, (i, s) in enumerate(own) for c in [least.get(root(k)) if s else i]), key=repr)


def _got(docs, size, percent):
    return sorted((tuple(r)[:4] for r in near_duplicates.near_duplicates(docs, size, percent).collect()), key=repr)


def _copies(seed=4):
    """Chains and groups of copies near the threshold, very short texts, repeated rows."""
    draw = np.random.default_rng(seed)
    rows, n = [], 0
    for size in (1, 2, 3, 7, 9, 20, 60, 200, 800):
        for _ in range(4):
            base = [f"w{x}" for x in draw.integers(0, 4000, size)]
            for _ in range(12):
                rows.append((n, " ".join(base)))
                n += 1
                for _ in range(max(1, round(size * 0.02 * draw.random()))):
                    if draw.random() < 0.7:
                        base[int(draw.integers(size))] = f"v{draw.integers(9)}"
                if draw.random() < 0.3:
                    base = base + [f"t{draw.integers(99)}"]
                    size = len(base)
    order = draw.permutation(n)
    return [(int(order[i]), t) for i, t in rows] + [(None, rows[0][1]), (7, rows[-1][1]), (None, "only null ids here to be seen"), (None, "only null ids here to be seen")]


def test_brute_force(spark, documents, odd):
    rows = _copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size, percent in ((3, 85), (5, 80)):
        assert _got(docs, size, percent) == _brute(rows, size, percent)
    for docs in (odd, documents):
        assert _got(docs, 3, 85) == _brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_groups_in_blocks(spark, monkeypatch):
    """A group of more classes than a block holds, whose members link in part only."""
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 7)
    draw = np.random.default_rng(12)
    base, rows = [f"w{x}" for x in range(160)], []
    for k in range(120):
        own = list(base)
        for _ in range(int(draw.integers(0, 12))):
            own[int(draw.integers(160))] = f"x{draw.integers(10 ** 6)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(docs, 3, 85) == _brute(rows, 3, 85)


def test_empty(none):
    assert near_duplicates.near_duplicates(none).count() == 0


def test_estimate():
    draw = np.random.default_rng(1)
    for shared, own in ((1000, 0), (900, 60), (500, 500), (0, 1000)):
        pool = draw.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
        a, b = np.unique(pool[:shared + own]), np.unique(np.concatenate([pool[:shared], pool[shared + own:]]))
        r = near_duplicates.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        c = near_duplicates.chance(np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(((r[0] == r[1]).mean() - c) / (1 - c) - shared / (shared + 2 * own)) < 0.2


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "_a long, _b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "_a long, _b long")).count() == 0


def test_shingles():
    import pyarrow as pa
    raw, offsets = words.terminated(pa.array(["a b c d", "", None, "x y", "a b c"]))
    hashes, firsts = near_duplicates.distinct_shingles(raw, offsets, 3)
    assert np.diff(firsts).tolist() == [2, 0, 0, 1, 1] and hashes[-1] in hashes[:2]
