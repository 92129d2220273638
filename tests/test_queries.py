"""Registered queries against their SQL on the smallest supplied tables (skipped where those are absent)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables absent")
NAMES = ["token_counts", "sentence_counts", "pii_redacted", "sanitise_lines", "library_listing", "term_idf", "bm25_permission_top5",
         "dense_permission_top5", "dense_cells_top5", "planted_sections", "session_search", "extractive_answer", "html_strip_upload", "rate_limit", "upload_cap", "audit_last_n"]


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    ref = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in ref.description]
    want = _rows(names, ref.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names) and _rows(df.columns, df.collect()) == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["dense_top5", "dense_permission_top5", "dense_cells_top5"])
def test_every_vector_asks_all(spark, tmp_path, name):
    rows = [(i, [float((i * k) % 7) for k in range(1, 4)], i % 3) for i in range(45)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()[name](spark, str(tmp_path)).collect()
    for qid, q, label in rows:
        own = [(-sum(a * b for a, b in zip(q, v)), i) for i, v, other in rows if name == "dense_top5" or other in (label, (label + 1) % 10)]
        assert sorted((r["rank"], r.doc) for r in found if r.qid == qid) == [(k, i) for k, (_, i) in enumerate(sorted(own)[:5])]
