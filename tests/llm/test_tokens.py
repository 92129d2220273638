import collections
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from docvault.llm import packing, pieces, token_files
from docvault.session import fresh_path

from .conftest import ODD

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def _ids(path, texts, end):
    return [e.ids + [end] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_tokenizers_ids(documents):
    texts = ODD + [r.text for r in documents.collect()]
    for path in (WORD, BYTE):
        want, got = _ids(path, texts, 7), []
        for _, ids, before, *_ in pieces.Encoder(path).documents(pa.array(texts)):
            got += [ids[a:b].tolist() + [7] for a, b in zip(before, before[1:])]
        assert got == want


def test_pieces_forget_and_learn_again(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_IDS", 10)
    one = pieces.Encoder(WORD)
    for _ in range(3):
        (_, ids, *_), = one.documents(pa.array(["alpha beta gamma delta epsilon zeta eta theta iota kappa"]))
        assert ids.tolist() == _ids(WORD, ["alpha beta gamma delta epsilon zeta eta theta iota kappa"], 0)[0][:-1]


def test_grammar_round_trip():
    draw = np.random.default_rng(5)
    for kinds, n in ((1, 1), (1, 500), (2, 3000), (50, 20000), (3000, 20000)):
        ids = (draw.zipf(1.3, n) % kinds).astype(np.int32) * 7
        sizes = np.diff(np.unique(np.concatenate([[0], draw.integers(1, n + 1, 9), [n]])))
        shard = token_files.Shard(token_files.pack(list(range(len(sizes))), ids, sizes))
        assert shard.documents(0, len(shard)).tolist() == ids.tolist()
        begin = 0
        for k, size in enumerate(sizes):
            assert shard.documents(k, k + 1).tolist() == ids[begin:begin + size].tolist()
            a = int(draw.integers(0, size))
            b = int(draw.integers(a, size)) + 1
            assert shard.slice(k, a, b - a).tolist() == ids[begin + a:begin + b].tolist()
            begin += size
    assert len(token_files.Shard(token_files.pack([1], np.zeros(500, np.int32), np.array([500]))).symbols) < 100


def test_only_pairs_that_may_be_frequent_are_sorted(monkeypatch):
    sorted_, frequent = [], token_files._frequent
    monkeypatch.setattr(token_files, "_frequent", lambda key, room: sorted_.append(len(key)) or frequent(key, room))
    draw = np.random.default_rng(6)
    ids = np.concatenate([draw.permutation(40_000), np.tile([0, 0, 1], 500)]).astype(np.int32)
    shard = token_files.Shard(token_files.pack([1], ids, np.array([len(ids)])))
    assert shard.documents(0, 1).tolist() == ids.tolist() and len(shard.symbols) < 40_200
    assert max(sorted_) < 5_000


def test_shards_hold_all_documents_in_order(spark, documents, odd, none):
    for docs in (documents, odd):
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        where = fresh_path(spark, "t")
        shards = token_files.write_tokens(docs, where, WORD, 2, shard_ids=3000)
        found = sorted(token_files.read_tokens(spark, shards, where, ids=True).collect(), key=lambda r: r.start)
        start = 0
        for r, (_, ids) in zip(found, sorted(((k, i) for (k, _), i in zip(rows, _ids(WORD, [t for _, t in rows], 2))), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
            assert (r.start, r.n_tokens) == (start, len(r.ids)) and r.ids_crc32 == _crc(r.ids)
            start += r.n_tokens
        want = collections.Counter((k, _crc(i)) for (k, _), i in zip(rows, _ids(WORD, [t for _, t in rows], 2)))
        assert collections.Counter((r.doc_id, r.ids_crc32) for r in found) == want
    where = fresh_path(spark, "t")
    assert token_files.read_tokens(spark, token_files.write_tokens(none, where, WORD, 2), where).count() == 0


def _check_packing(rows, found):
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
    want = collections.Counter((k, tuple(i)) for (k, _), i in zip(rows, _ids(BYTE, [t for _, t in rows], 0)))
    order = sorted(found, key=lambda r: (r.sequence_id, r.offset))
    got, open_ = collections.Counter(), {}
    for r in order:
        ids = open_.setdefault(r.doc_id, [])
        assert r.start == len(ids) and _crc(r.ids) == r.ids_crc32
        ids += r.ids
        if len(ids) == r.doc_tokens:
            got[(r.doc_id, tuple(open_.pop(r.doc_id)))] += 1
    assert got == want and not open_
    return sequences


def test_packing(documents, odd, none):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        sequences = _check_packing(rows, packing.pack_documents(docs, BYTE, 0, ids=True).collect())
    assert packing.pack_documents(none, BYTE, 0).count() == 0
    del sequences


def test_cuts_are_optimal():
    draw = np.random.default_rng(3)
    for k in range(120):
        window = 8 if k % 3 == 0 else int(draw.integers(4, 20))
        places = np.cumsum(np.concatenate([[0], draw.integers(1, window + 1, int(draw.integers(1, 12)))])).tolist()
        penalties = draw.integers(0, 6, len(places)).tolist()
        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + int(packing.padding(np.array(places[j] - places[i]), window)) + penalties[j] for i in range(j) if places[j] - places[i] <= window)
        cost, low = 0, 0
        for c in packing.choose_cuts(places, penalties, window):
            assert c - low <= window
            cost, low = cost + int(packing.padding(np.array(c - low), window)) + penalties[places.index(c)], c
        assert cost == best[len(places) - 1] and low == places[-1]


def test_little_padding(spark, documents):
    found = packing.pack_documents(documents.repartition(1), BYTE, 0).groupBy("sequence_id").agg({"length": "sum"}).collect()
    lengths = np.array([r[1] for r in found])
    # Each task's last sequence is as long as its rest is; elsewhere little is lost.
    assert packing.padding(lengths).sum() < 0.03 * lengths.sum() + 4 * packing.WINDOW
    assert packing.padding(np.array([1, 2, 3, 512, 1000, 1024])).tolist() == [0, 0, 1021, 0, 24, 0]


def test_a_third_without_id_is_spread(spark, documents):
    from pyspark.sql import functions as F
    rows = documents.select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("doc_id"), F.concat("text", F.col("doc_id").cast("string")).alias("text"))
    many = rows.crossJoin(spark.range(5)).select("doc_id", F.concat("text", F.col("id").cast("string")).alias("text"))
    where = fresh_path(spark, "t")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        shards = token_files.write_tokens(many, where, WORD, 2, shard_ids=10**9).collect()
        packed = packing.pack_documents(many, BYTE, 0).filter("start = 0").groupBy(F.shiftright("sequence_id", 33).alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for sizes in ([r.documents for r in shards], [r["count"] for r in packed]):
        assert sum(sizes) == many.count() and max(sizes) <= 2 * sum(sizes) / 8


def test_grammar_ends_by_itself():
    # No pair that occurs often enough is left where symbols remain.
    draw = np.random.default_rng(8)
    ids = np.concatenate([np.tile(draw.integers(0, 500, 64), 300), draw.integers(0, 500, 3000)]).astype(np.int32)
    known, symbols = np.unique(ids, return_inverse=True)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    left, _, out, ends = token_files.repair(symbols, last, len(known))
    pairs = collections.Counter(zip(out[:-1][~ends[:-1]].tolist(), out[1:][~ends[:-1]].tolist()))
    assert len(left) > 64 and max(pairs.values()) < 2 * token_files.LEAST_COUNT and len(out) < 8000


def test_a_path_that_only_spark_settles(spark, documents):
    # Without a scheme the folder is on Spark's default file system; tasks get its full address.
    from docvault.session import qualified, shared_folder
    bare = shared_folder(spark).removeprefix("file:") + "/bare"
    assert qualified(spark, bare).startswith("file:/")
    shards = token_files.write_tokens(documents, bare, WORD, 2)
    assert token_files.read_tokens(spark, shards, bare).count() == documents.count()
    assert all(r.path.startswith("/") for r in shards.collect())


def test_known_pieces_take_the_room_they_need():
    import numpy as np
    from docvault.llm.pieces import Known
    known, rng = Known(), np.random.default_rng(5)
    assert len(known.keys) <= 1 << 16
    keys = np.unique(rng.integers(1, 1 << 63, 150_000, dtype=np.uint64))
    for low in range(0, len(keys), 40_000):
        part = keys[low:low + 40_000]
        known.add(part, np.arange(low, low + len(part)))
    assert (known.find(keys) == np.arange(len(keys))).all() and (known.find(keys + np.uint64(1 << 63)) == -1).all()
    assert 2 * len(keys) <= len(known.keys) <= 8 * len(keys)
