import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions.text import normal_form, py_normal_form, py_tokens, title_or_stem, tokens, word_chunks

CASES = [
    ("PyThOn PYTHON Straße STRASSE", "python python strasse strasse"),
    ("café café", "café café"),
    ("don't п’ять пʼять п'ять", "don't п'ять п'ять п'ять"),
    ("'word' ‘word’", "word word"),
    ("well-known пів–Європи a—b", "well known пів європи a b"),
    ("Python3 2026 3.12 snake_case", "python3 2026 3 12 snake case"),
    ("Hello... (world)! 😀", "hello world"),
    (" \t\n … !", ""),
    ("", ""),
    ("Σας ΟΔΟΣ ﬁn", "σασ οδοσ fin"),
]


def test_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "i int, text string")
    got = {r.i: r.t for r in rows.select("i", tokens(F.col("text")).alias("t")).collect()}
    for i, (text, expected) in enumerate(CASES):
        assert got[i] == expected.split() == py_tokens(text)
    assert got[99] == []


# letters of scripts younger than the Java version's Unicode are no letters to it; those of Unicode 3.2 are known to both
KNOWN = [c for c in map(chr, range(32, 0x3000)) if unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Cs", "Co")]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(KNOWN), max_size=30), min_size=1, max_size=40))
def test_jvm_and_python_agree(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    for r in rows.select("text", normal_form(F.col("text")).alias("n"), tokens(F.col("text")).alias("t")).collect():
        assert r.n == py_normal_form(r.text)
        assert r.t == py_tokens(r.text)
        assert unicodedata.is_normalized("NFC", r.n)


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "a string").select(normal_form(F.col("a"))).first()[0] is None


@pytest.mark.parametrize(
    "text, size, overlap, expected",
    [("a b c d e f", 4, 2, ["a b c d", "c d e f"]), ("a b", 4, 2, ["a b"]), ("", 4, 2, []), (None, 4, 2, []), ("a b c", 2, 0, ["a b", "c"])],
)
def test_word_chunks(spark, text, size, overlap, expected):
    row = spark.createDataFrame([(text,)], "t string").select(word_chunks(F.col("t"), size, overlap)).first()
    assert row[0] == expected


def test_word_chunks_argument():
    with pytest.raises(ValueError):
        word_chunks(F.col("t") if False else None, 4, 4)


def test_title(spark):
    rows = [("T", "x/a.txt"), ("", "x/big_file.v2.txt"), (None, "plain"), (None, None)]
    df = spark.createDataFrame(rows, "title string, path string").select(title_or_stem(F.col("title"), F.col("path")))
    assert [r[0] for r in df.collect()] == ["T", "big file.v2", "plain", ""]
