import pytest

FOLDER = "/root/testdata/sf0.001"

# Texts that the operators must bear: null, empty, blank, odd spaces, marks, repeated lines, one very long word and text.
ODD = [None, "", " ", "\n", "a", "a  b \n c", "x  y", "x 　y\n\nz", "l'été d'un\ttab", "it's  we'll ' s 's", "<|endoftext|> foo<|endoftext|>\nbar",
       " lead", "trail ", "e ́x", "1 2 3\n4", "Ünïcödé ñ 漢字 テスト 漢 字", "a\r\nb \r c",
       "x \x1c y\x85 z", "same line\nsame line\nsame line", "w" * 20000, "one two three four five six seven. " * 900, "\U0001f600 \U0001f600"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a null id, a repeated row and columns whose names could clash."""
    rows = [(k if k != 3 else None, t, None, "s", 0, "x", 1) for k, t in enumerate(ODD)]
    rows += [rows[4], (100, "one two three four five six seven. " * 900, "en", None, None, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, start int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
