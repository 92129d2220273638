import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docvault.llm import byte_pairs, queries
from docvault.llm.words import worker_cache

from .conftest import FOLDER, ODD

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def _coder():
    return worker_cache("test coder", lambda: byte_pairs.Coder(BYTE))


def _library(texts):
    return [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library():
    draw = random.Random(3)
    letters = "aabbeetthhinoo sr'.,\n\t 0123é漢\U0001f600ßñ<|\x00\x85"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(4000)]
    texts += [c * n for c in "aw =-.\n" for n in (1, 2, 3, 7, 64, 999)] + ["ab" * 2000, "<|endoftext|>", "a<|endoftext|><|endoftext|> <|endoftext", "it's WE'LL 's"]
    assert [_coder()._piece(t) for t in texts] == _library(texts)


def test_long_piece_is_linear():
    # A run without a space is one piece; a quadratic encoder would take minutes.
    text = "".join(random.Random(5).choice("etaoin") for _ in range(200_000))
    assert _coder()._piece(text) == _library([text])[0]


def test_order_of_equal_merges_and_backtracking():
    # aa before ab: "aaa" is aa|a, "aab" is aa|b although ab is a token; the longest first token of "abcd" leads nowhere.
    own = byte_pairs.Vocabulary({"a": 0, "b": 1, "c": 2, "d": 3, "aa": 4, "ab": 5, "cd": 6, "abc": 7}, [("a", "a"), ("a", "b"), ("c", "d"), ("ab", "c")])
    for text, want in (("aaa", [4, 0]), ("aab", [4, 1]), ("abcd", [5, 6]), ("aaaa", [4, 4]), ("abc", [7]), ("", [])):
        assert own.encode(text) == want
    # A token that its own bytes never give stays unused.
    own = byte_pairs.Vocabulary({"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5}, [("b", "c"), ("a", "b"), ("ab", "c")])
    assert own.encode("abc") == [0, 3]


def test_pairs_forget(monkeypatch):
    monkeypatch.setattr(byte_pairs, "KNOWN_PAIRS", 3)
    texts = ["unbelievable internationalisation of things", "zzxxyyqq" * 30]
    assert [_coder()._piece(t) for t in texts] == _library(texts)


def test_decode_any_ids():
    library, coder = Tokenizer.from_file(BYTE), _coder()
    draw = np.random.default_rng(1)
    runs = [draw.integers(0, 50257, n) for n in (0, 1, 5, 40, 300)] + [np.array([0xE2 - 33, 220, 50256, 128, 200])]
    before = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    assert coder.decode(np.concatenate(runs), before).to_pylist() == [library.decode(r.tolist(), skip_special_tokens=False) for r in runs]
    assert coder.decode(np.array([-1, 50257, 10**6]), np.array([0, 3])).to_pylist() == [""]
    assert len(coder.decode(np.zeros(0, np.int64), np.zeros(1, np.int64))) == 0


def test_rows(spark, odd, none):
    rows = odd.collect()
    found = byte_pairs.encode(odd, BYTE, decoded=True)
    got = sorted((r.doc_id is None, r.doc_id, r.ids, r.decoded) for r in found.collect())
    assert got == sorted((r.doc_id is None, r.doc_id, i, r.text or "") for r, i in zip(rows, _library([r.text or "" for r in rows]), strict=True))
    texts = sorted((r.doc_id or -1, r.text) for r in byte_pairs.decode(found.withColumn("text", F.lit(0)), BYTE).collect())
    assert texts == sorted((r.doc_id or -1, r.text or "") for r in rows)
    odd_ids = spark.createDataFrame([(1, None), (2, [None, 64, 99999999])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, byte_pairs.decode(odd_ids, BYTE).collect())) == [(1, ""), (2, Tokenizer.from_file(BYTE).decode([64]))]
    assert byte_pairs.encode(none, BYTE, decoded=True).count() == 0 and len(ODD) > 0


def test_query(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = {(r.doc_id, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
            for r, i in zip(rows, _library([r.text for r in rows]), strict=True)}
    found = queries.QUERIES["op12_byte_pairs"](spark, FOLDER)
    assert {tuple(r) for r in found.collect()} == want
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def test_array_of_text_column_kinds():
    own = _coder()
    for kind in (pa.string(), pa.large_string()):
        (_, ids, before, *_), = own.documents(pa.array(["a b", None, ""], kind))
        assert ids.tolist() == _library(["a b"])[0] and before.tolist() == [0, 2, 2, 2]
