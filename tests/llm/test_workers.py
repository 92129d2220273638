"""Workers that can't import the package: the driver adds its folder to its own path only, as a cluster's driver does."""

import os
import subprocess
import sys

import pytest

from docvault.llm import language, suffix_dedup

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
sys.path.insert(0, {HERE!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[1]).config("spark.driver.memory", "3g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
def missing(_):
    try:
        import docvault
        yield 1
    except ModuleNotFoundError:
        yield 0
assert sum(spark.sparkContext.parallelize(range(4), 4).mapPartitions(missing).collect()) == 0
for name in sys.argv[3:]:
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


def test_queries_run_without_the_package(tmp_path):
    names = sorted(n for n in ("op2_warc", "op3_repair", "op4_suffix_array", "op5_compression_bands", "op6_tiling", "op7_language_model", "op8_language",
                               "op9_hyperminhash", "op10_packing", "op11_spelling", "op12_byte_pairs", "op13_collocations", "pipeline"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), "/root/testdata/sf0.001", *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[0] in names] == names


def test_kept_columns_that_clash(spark, documents):
    with pytest.raises(ValueError):
        language.identify(documents, None, [], keep=("score",))
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(documents, carry=("n_bytes",))


def test_odd_columns_do_not_clash(spark, documents):
    from pyspark.sql import functions as F
    docs = documents.withColumns({n: F.lit(1) for n in ("_n", "_lang", "_id", "score", "n_bytes", "_text")})
    network, languages = language.train(docs, per_language=20)
    assert language.identify(docs, network, languages).count() == documents.count()
    assert suffix_dedup.remove_repeats(docs).count() == documents.count()
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(Exception):  # noqa: B017
        suffix_dedup.remove_repeats(docs.withColumn("text", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("lost")))))
    assert {t.name for t in spark.catalog.listTables()} == before
