import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.functions import text as T
from docvault.operators import glossary
from patterns import python_pattern


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("The G5 managers' studies, 1,500 classes and 30%", ["g5", "manager", "study", "1500", "class", "30%"]),
    ("ＡＢＣ ﬁles", ["abc", "fil"]),
    ("éeaux aux", ["eaux", "aux"]),
    ("training passed boxes ties bees", ["train", "pass", "box", "tie", "bee"]),
    ("الإجازة السنوية", ["اجاز", "سنو"]),
    ("في على كتاب", ["علي", "تاب"]),
    ("", []),
])
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens("t")) == want


def test_arabic_folding_and_script(spark):
    assert one(spark, "إِجَازَة", T.normalise_ar(F.col("t"))) == "اجازه"
    assert one(spark, "abc ساعات العمل", T.is_arabic(F.col("t"))) is True
    assert one(spark, "working hours عمل", T.is_arabic(F.col("t"))) is False
    assert not one(spark, "1234", T.is_arabic(F.col("t")))


def test_stems_match_the_fixed_table_rules(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abeidgns") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    words += ["".join(rng.choice("والبكفهماتنيسر") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", T.finish_tokens(F.array("w"), stop=False)[0].alias("s")).collect()
    assert [(r.w, r.s) for r in got] == [(w, glossary.plain_stem(w)) for w in words]


def test_sentences(spark):
    text = "Hours are fixed. They start at 8! ok? yes.\n- Bring a badge. Always.\n2) Sign in\n\n  A. \r\nLast one (see b). (c) d"
    assert one(spark, text, T.sentences("t")) == [
        "Hours are fixed.", "They start at 8! ok? yes.", "Bring a badge. Always.", "Sign in", "Last one (see b).", "(c) d"]


def test_numbers_pairs_and_words(spark):
    assert one(spark, "AED 1,500.50 and ٣٤ and 1,500.50", T.numbers(F.col("t"))) == ["1500.50", "34"]
    assert one(spark, "red box red box", T.pairs(T.tokens("t"))) == ["red box", "box red"]
    assert one(spark, " a\t b c ", T.word_count(F.col("t"))) == 3
    assert one(spark, "q", T.question_id(F.col("t"))) == "8e35c2cd3bf6"


def test_tokens_against_a_plain_loop(spark):
    """Row-at-a-time specification over the supplied documents and random mixtures of scripts."""
    def plain(s):
        s = unicodedata.normalize("NFKC", s)
        s = regex.sub(python_pattern(V.AR_MARKS), "", s).translate(str.maketrans(*V.AR_FOLD)).lower()
        out = []
        for t in regex.findall(python_pattern(V.TOKEN), s):
            if t[0].isdigit():
                out.append(t.replace(",", ""))
            elif t not in V.EN_STOP and t not in V.AR_STOP:
                out.append(glossary.plain_stem(t))
        return out

    rng = random.Random(5)
    alphabet = "abcXYZés 019٣٤.,%-وال كتابهéﬁ½ＡＢ\nـَ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens("t").alias("x")).collect()
    for r in got:
        assert r.x == plain(r.t), r.t


def test_expansion_both_ways(spark):
    df = spark.createDataFrame([(["leave", "day"],), (["مجلس", "ادار"],)], "t array<string>")
    en, ar = [r.x for r in df.select(glossary.expansion("t").alias("x")).collect()]
    assert "اجاز" in en and "vacation" in en and "leave" not in en
    assert "board" in ar


def test_token_pattern_tries_no_shorter_runs(spark):
    draw = random.Random(5)
    rows = [("".join(draw.choice("abZ \u0130\u212a19\u0663.,%\u0639\u0644\u064b_-é") for _ in range(draw.randrange(40))),) for _ in range(3000)]
    low = spark.createDataFrame([*rows, ("a" * 5000 + "1",), ("",), (None,)], "t string").select(F.lower("t").alias("t"))
    both = low.select(F.regexp_extract_all("t", F.lit(V.TOKEN), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(T._TOKEN), F.lit(0)).alias("b"))
    assert both.filter("not (a <=> b)").isEmpty() and both.filter("size(a) > 3").count() > 1000
