import pytest
from pyspark.sql import functions as F

from quire.functions import text as X


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("before,after", [
    ("‘‘Legal Positivism’’", "“Legal Positivism”"), ("beneﬁt aﬃrmed ﬂow", "benefit affirmed flow"), ("Positivism: 51⁄2 Myths", "Positivism: 5½ Myths"),
    ("pp. 199–227", "pp. 199–227"), ("KEITH  HITCHINS   University of Illinois", "KEITH HITCHINS University of Illinois"), ("4⁄7", "4/7"), ("1⁄23", "1⁄23"), ("", ""),
])
def test_normalize(spark, before, after):
    assert one(spark, X.normalize, before) == after


def test_garbled(spark):
    assert one(spark, X.is_garbled, "\x01\x02abc")
    assert not one(spark, X.is_garbled, "plain text\twith\n")
    assert not one(spark, X.is_garbled, "")


@pytest.mark.parametrize("text,other", [("τὸν λόγον", True), ("слово божие", True), ("românește și", False), ("un text românesc obișnuit cu un singur cuvânt λόγος", False), ("abc", False)])
def test_other_script(spark, text, other):
    assert one(spark, X.is_other_script, text) == other


@pytest.mark.parametrize("text,debris", [("Λ", True), ("■", True), ("a", False), ("12", False), ("", False), ("abc", False)])
def test_debris(spark, text, debris):
    assert one(spark, X.is_debris, text) == debris


def test_hyphens(spark):
    assert one(spark, X.ends_hyphenated, "Litur­ ")
    assert not one(spark, X.ends_hyphenated, "word")
    assert one(spark, X.drop_break_hyphen, "Know- ") == "Know"
    assert one(spark, X.dehyphenated, ["Human Know-", "ledge", "Its Scope"], "array<string>") == "Human Knowledge Its Scope"
    assert one(spark, X.dehyphenated, ["page", "113, vol. 3"], "array<string>") == "page 113, vol. 3"


def test_running_key(spark):
    assert one(spark, X.running_key, "  THE  Long Road 12 ") == "the long road #"


def test_names(spark):
    assert one(spark, X.safe_stem, "a/b:c.pdf") == "a_b_c.pdf"
    assert one(spark, X.safe_stem, "  ") == "book"
    assert one(spark, X.safe_stem, None) == "book"
    assert one(spark, X.media_type, ".JPG") == "image/jpeg"
    assert one(spark, X.media_type, "xyz") == "image/png"


def test_quotes(spark):
    assert one(spark, X.quoted, 'a"b') == "'a\"b'"
    assert one(spark, X.quoted, "a\"b'") == "\"a&quot;b'\""
    assert one(spark, X.escape, "<a&b>") == "&lt;a&amp;b&gt;"
