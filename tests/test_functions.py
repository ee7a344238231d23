from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors
from tidemark.functions.times import virtual_seconds, virtual_text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_normal_forms():
    assert X.fold("  Ｓtraße 　X ") == "strasse x"
    assert X.tidy(" Ａ b ") == "A b"
    assert X.evidence_form("It’s, “fine”​!") == "itsfine"
    assert X.eligible_form("a​B 　c") == "ab c"
    assert X.ngrams("") == [] and X.ngrams("ab") == ["ab"] and X.ngrams("abab") == ["aba", "bab"]


def test_evidence_slice():
    assert X.evidence_slice("He said: “Good – morning”, twice", "good morning") == "Good – morning"
    assert X.evidence_slice("abc", "xyz") is None
    assert X.evidence_slice("abc", " ,. ") is None
    assert X.evidence_slice(None, "a") is None and X.evidence_slice("", "a") is None


@given(st.text(max_size=60))
def test_slice_of_itself(text):
    if X.evidence_form(text) and "".join(map(X.evidence_form, text)) == X.evidence_form(text):
        assert X.evidence_form(X.evidence_slice(text, text)) == X.evidence_form(text)


def test_columns(spark):
    assert one(spark, X.nfkc_casefold("a"), a="Ｘ  Y") == "x y"
    assert one(spark, X.nfkc_casefold("a"), a=None) is None
    assert one(spark, X.collapse("a"), a="　a\u001c b ") == "a b"
    assert one(spark, X.canonical("a"), a='{"b": 1, "a": [2, null]}') == '{"a":[2,null],"b":1}'
    assert one(spark, X.whole_word(F.col("a"), "no"), a="a notebook") is False
    assert one(spark, X.whole_word(F.col("a"), "no"), a="No, thanks") is True
    assert one(spark, X.visible_text(F.col("a"), F.col("b")), a=" t ", b="c") == "Dense caption: c\nTranscript: t"
    assert one(spark, X.visible_text(F.col("a"), F.col("b")), a=None, b=" ") == ""


def test_virtual_time(spark):
    assert one(spark, virtual_seconds(F.col("a")), a="D02 01:00") == 86_400 + 3_600
    assert one(spark, virtual_seconds(F.col("a")), a="D01 24:00") is None
    assert one(spark, virtual_seconds(F.col("a")), a="D00 01:00") is None
    assert spark.range(1).select(virtual_text(F.lit(90_061))).first()[0] == "D02 01:01:01"
    assert spark.range(1).select(virtual_text(F.lit(99 * 86_400))).first()[0] is None


def test_vectors(spark):
    df = spark.sql("select array(3f, 4f) a, array(0f, 0f) z, map('x', 2d, 'y', 1d) m, map('y', 5d) n")
    r = df.select(vectors.dot(F.col("a"), F.col("a")).alias("d"), vectors.normalized(F.col("a")).alias("u"), vectors.normalized(F.col("z")).alias("v"), vectors.sparse_dot(F.col("m"), F.col("n")).alias("s")).first()
    assert r.d == 25 and r.u == [0.6, 0.8] and r.v is None and r.s == 5


def test_jaccard(spark):
    df = spark.sql("select array('a','b') a, array('b','c') b, cast(array() as array<string>) e")
    r = df.select(X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("e"), F.col("e")), X.jaccard(F.col("a"), F.col("e"))).first()
    assert tuple(r) == (1 / 3, 1.0, 0.0)
