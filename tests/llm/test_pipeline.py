import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from docvault.llm.queries import QUERIES

from .conftest import FOLDER
from .test_near_duplicates import _brute
from .test_quality_tiling import _greedy, _words
from .test_repeats import _brute as _repeats


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) >= {"op1_url_filter", "op2_warc", "op4_suffix_array", "op9_hyperminhash", "op11_spelling", "op13_collocations"}


def test_stages(spark, documents):
    """Every stage against a plain loop on what it was given; columns stay those of documents."""
    docs, tables = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == documents.columns, name
        where = corpus_pipeline.materialise(out, name)
        tables.append((name, docs, where))
        docs = where
    steps = {name: ([(r.doc_id, r.text) for r in before.collect()], after.collect()) for name, before, after in tables}
    before, after = steps["language"]
    letters = {i for i, t in before if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in after} <= letters and len(after) >= 0.97 * len(letters)
    before, after = steps["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, _, kept in _brute(before, 5, 80) if kept)
    before, after = steps["repeats"]
    want = {i: (n, gone) for i, n, gone, *_ in _repeats(before)}
    for r in after:
        n, gone = want[r.doc_id]
        assert n - gone - 6 <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)
    assert {i for i, (n, gone) in want.items() if n - gone > 20} <= {r.doc_id for r in after}
    before, after = steps["decontamination"]
    items = [_words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = set()
    for i, t in before:
        w = _words(t)
        grams = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        if any(any(tuple(x[k:k + 5]) in grams for k in range(len(x) - 4)) and _greedy(w, x, 5) >= 0.6 * len(x) for x in items):
            bad.add(i)
    assert bad and {r.doc_id for r in after} == {i for i, _ in before} - bad
    before, after = steps["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in before}


def test_odd_rows(spark, odd, none, tmp_path):
    """Nulls, repeated rows and empty tables pass through all stages."""
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    columns = odd.select(*corpus_pipeline.COLUMNS).withColumn("n_chars", F.col("n_chars").cast("long"))
    for k, docs in enumerate((columns, columns.limit(0))):
        folder = str(tmp_path / str(k))
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.limit(3 if k == 0 else 0).write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert (len(out) == 0) == (k == 1)


def test_decontamination_judges_rows(spark, tmp_path):
    """Of rows that share an id, null or not, only those with a contaminated text go."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} it says", "en", "s", 1), (None, "a clean text of its own", "en", "s", 1), (7, item, "en", "s", 1), (7, "another clean text", "en", "s", 1), (0, "third clean text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_tests(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(0, "third clean text"), (7, "another clean text"), (None, "a clean text of its own")]


def test_one_of_each_judges_rows(spark):
    """One row of each group of near copies stays where ids are null or shared, and where rows repeat."""
    text = lambda name, end="": " ".join(f"{name}{k}" for k in range(60)) + end
    rows = [(None, text("a")), (None, text("a", " more")), (None, text("a", " other")), (5, text("b")), (5, text("b", " more")), (9, text("b", " other")),
            (None, text("c")), (3, text("c", " more")), (None, text("d")), (None, text("d")), (5, text("e")), (None, text("f")), (-(1 << 63), text("g")), (None, text("g"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(((r.text[0], r.doc_id) for r in corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()), key=repr)
    assert kept == sorted([("a", None), ("b", 5), ("c", 3), ("d", None), ("e", 5), ("f", None), ("g", -(1 << 63))], key=repr)
