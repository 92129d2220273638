import base64
import re

import numpy as np
from pyspark.sql import functions as F

from docvault.llm import quality, tiling


def _base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k:k + 3]), []).append(k)
    repeated = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(3)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), failed


def test_base_counts(documents, odd, none):
    for docs in (documents, odd):
        found = quality.compression_bands(docs).collect()
        texts = docs.collect()
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=repr)
        assert got == sorted(((r.doc_id, *_base(r.text)) for r in texts), key=repr)
        assert all(not (r.kept and r.base_failed) for r in found)
    assert quality.compression_bands(none).count() == 0


def test_bands(spark, documents):
    draw = np.random.default_rng(2)
    clean = max((r.text for r in documents.limit(80).collect()), key=len)
    junk = base64.b64encode(draw.bytes(9000)).decode()
    cases = [("clean", clean, None), ("repeated", "the same few words come again and again " * 200, "repetitive"), ("random", junk, "incompressible"),
             ("mixed", clean[:3000] + "".join(map(chr, draw.integers(33, 127, 8192))) + clean[:2000], "incompressible"), ("spoiled", "ha " * 9000 + clean * 2, None)]
    rows = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.compression_bands(rows).collect()}
    for k, (name, _, reason) in enumerate(cases[:4]):
        assert found[k].reason == reason, name
    assert found[4].n_bad_chunks > 0 and found[4].n_chunks > found[4].n_bad_chunks


def test_bands_agree_with_labels(spark):
    """Labelled as good: hardly any is rejected by a band."""
    folder = "/root/testdata/sf0.01"
    found = quality.compression_bands(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    good = found.filter("quality = 1")
    assert good.filter(F.col("reason").isNotNull()).count() <= 0.01 * good.count()


def test_chunks_cover_every_text():
    """A spoiled tail and a spoiled part of a short text count by their bytes."""
    import zstandard
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False)
    draw = np.random.default_rng(5)
    words = ["".join(map(chr, draw.integers(97, 123, int(n)))) for n in draw.integers(2, 10, 900)]
    prose = lambda n: " ".join(words[k] for k in (draw.random(n) ** 2 * len(words)).astype(int)).encode()[:n]
    judge = lambda *parts: quality.judge(memoryview(b"".join(parts)), packer)[1:]
    junk = lambda n: base64.b64encode(draw.bytes(n))[:n]
    # One clean chunk, one spoiled chunk and a spoiled tail of 4,095 bytes.
    assert judge(prose(4096), b"ha " * 1365 + b"h", (b"ha " * 1365))[:2] == (3, 2)
    assert judge(prose(4096), b"ha " * 1365 + b"h", prose(4095))[:2] == (3, 1)
    for n in (256, 512, 1024, 2048, 4096):
        assert judge(*[prose(n) for _ in range(3)])[1:] == (0, None)
        assert judge(prose(n), b"ha " * n)[0] == -(-4 * n // quality.chunk_size(4 * n))
    # Half of a text under 8 KiB is spoiled both ways; the whole text is within its limits.
    assert judge(prose(1024), (b"ha " * 342)[:1024], junk(1024), prose(928)) == (4, 2, "chunks")
    assert quality.judge(memoryview(prose(300)), packer)[1:] == (1, 0, None) and quality.judge(memoryview(b""), packer) == (1.0, 0, 0, None)


def _greedy(text, item, least):
    """String tiling as first described: all maximal matches of free words, longest first, until none is left."""
    used_t, used_i, covered = [False] * len(text), [False] * len(item), 0
    while True:
        best, found = least - 1, []
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and not used_t[p + n] and not used_i[q + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, q)]
                elif n == best and n >= least:
                    found.append((p, q))
        if not found:
            return covered
        for p, q in found:
            if not any(used_t[p:p + best]) and not any(used_i[q:q + best]):
                used_t[p:p + best] = used_i[q:q + best] = [True] * best
                covered += best


def _words(text):
    return [re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w) or w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def test_tiles_are_greedy():
    draw = np.random.default_rng(8)
    for _ in range(150):
        text, item = (draw.integers(0, int(draw.integers(2, 9)), int(draw.integers(1, 40))).astype(np.uint64) for _ in range(2))
        least = int(draw.integers(1, 4))
        seeds = [(p, q) for p in range(len(text) - least + 1) for q in range(len(item) - least + 1) if (text[p:p + least] == item[q:q + least]).all()]
        if not seeds:
            continue
        tiles = tiling.tile(text, item, *np.array(seeds).T, least)
        for p, q, n in tiles:
            assert n >= least and (text[p:p + n] == item[q:q + n]).all()
        for k in range(2):
            places = [x for t in tiles for x in range(t[k], t[k] + t[2])]
            assert len(places) == len(set(places))
        want = _greedy(text.tolist(), item.tolist(), least)
        # Ties between equally long tiles may be taken in another order.
        assert abs(sum(n for *_, n in tiles) - want) <= 2 * least + 2


def test_contamination(spark, documents, odd, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: _words(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id): (r.item_words, r.covered_words) for r in tiling.contaminated(documents, bench).collect()}
    want = {}
    for r in documents.collect():
        w = _words(r.text)
        grams = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        for i, item in items.items():
            if any(tuple(item[k:k + 5]) in grams for k in range(len(item) - 4)) and (n := _greedy(w, item, 5)) >= 0.6 * len(item):
                want[r.doc_id, i] = (len(item), n)
    assert got == want and want
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi"
    tests = spark.createDataFrame([(1, one, 0), (2, "Two, words", 0), (3, None, 0), (4, " ", 0), (None, one, 0), (1, one, 0)], "item_id long, text string, doc_id int")
    moved = "Nu xi omikron pi, and so: lamda mu. IOTA kappa lamda mu nu! some theta alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, moved), (2, "just two words here"), (3, one[:40]), (None, one), (4, None), (5, "")], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    found = tiling.contaminated(docs, tests).collect()
    assert sorted({(r.doc_id, r.item_id) for r in found}, key=repr) == sorted({(1, 1), (1, None), (2, 2), (None, 1), (None, None)}, key=repr)
    assert tiling.contaminated(none, tests).count() == 0 and tiling.contaminated(docs, tests.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, documents, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, tiling.contaminated(documents, bench).collect()))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, tiling.contaminated(documents, bench).collect())) == whole
