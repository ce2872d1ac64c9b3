import pytest
from pyspark.sql import functions as F

from quire.operators import repair as R
from quire.sources import external
from tests.helpers import line, lines, span

WORDS = frozenset("bisericii academice rugându actualitate și pre teologia complicată compli adică descoperă ediţiile cată tainic toate".split())


def swapped(spark, old, new, replaced=False):
    """Swaps between two readings. replaced: one stands for the other as a whole."""
    lexicon = spark.createDataFrame([("ro", w) for w in WORDS], "lang string, word string")
    if replaced:
        places = spark.createDataFrame([(0, 0, old, new)], "line int, ord int, was array<string>, now array<string>")
    else:
        places = R.differences(spark.createDataFrame([(0, old, new)], "line int, old array<string>, new array<string>"))
    return [(r.old, r.new) for r in R.swaps(places, lexicon).orderBy("ord").collect()]


@pytest.mark.parametrize("old,new,want", [
    ("Biseridi", "Bisericii", "Bisericii"), (".iradcmice,", "academice,", "academice,"), ("(Biseridi)", "(Bisericii)", "(Bisericii)"), ("Bisericii", "Bisericij", None), ("Pruteanu", "Prufeanu", None),
    ("rugăndu-se,", "rugându-se,", "rugându-se,"), ("compli-", "compli", None), (".iradcmice-", "academice", "academice-"), ("ACTUALn'ATE", "ACTUALITATE", "ACTUALITATE"), ("111-a,", "111-III,", None),
    ("<·<", "pre", "pre"), ("1Adicx", "Adică", None), ("1Adicx", "1Adică", "1Adică"), (".1", "și", "și"), ("Npie", "“pre", "pre"),
])
def test_one_word_for_one(spark, old, new, want):
    assert swapped(spark, [old], [new], replaced=True) == ([(old, want)] if want else [])


@pytest.mark.parametrize("old,new,want", [
    ("«It scoperă tainic toate", "descoperă tainic toate", [("«It scoperă", "descoperă")]), ("teologia xqzz", "academice", []), ("xqzz wvqq", "", []), ("Bisericii xqzz", "Bisericii", []),
    ("1 F.diţiile", "Ediţiile", []), ("1 F.diţiile", "1 Ediţiile", [("F.diţiile", "Ediţiile")]), ("i .it«1,", "cată,", [("i .it«1,", "cată,")]),
])
def test_runs_of_words(spark, old, new, want):
    assert swapped(spark, old.split(), new.split()) == want


def test_words_to_lines(spark):
    ls = lines(spark, [line(0, "left", x0=72, x1=280), line(1, "right", x0=320, x1=520, y0=100.0)])
    ws = spark.createDataFrame([("b", 0, 0, "alpha", 80.0, 100.0, 120.0, 112.0), ("b", 0, 1, "omega", 330.0, 100.0, 380.0, 112.0), ("b", 0, 2, "far", 80.0, 400.0, 120.0, 412.0)], "book_id string, page_no long, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.text: r.line_no for r in R.words_to_lines(ws, ls).collect()} == {"alpha": 0, "omega": 1}


def test_repair_keeps_spans(spark):
    ls = lines(spark, [line(0, [span("teologia şi "), span("Biseridi", flags=16), span(" şi")])])
    ws = spark.createDataFrame([("b", 0, i, t, 72.0 + 60 * i, 100.0, 120.0 + 60 * i, 112.0) for i, t in enumerate("teologia şi Bisericii şi".split())], "book_id string, page_no long, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    lexicon = spark.createDataFrame([("ro", w) for w in WORDS], "lang string, word string")
    got = R.apply_repairs(ls, R.line_repairs(ls, ws, lexicon)).first()
    assert got.n_repairs == 1 and [s.text for s in got.spans] == ["teologia şi ", "Bisericii", " şi"] and got.spans[1].flags == 16 and got.spans[1].bbox == ls.first().spans[1].bbox


def test_lexicon_score(spark):
    lexicon = spark.createDataFrame([("ro", w) for w in WORDS], "lang string, word string")
    ls = lines(spark, [line(0, "teologia bisericii tainic toate xq"), line(1, "xq wv teologia bisericij"), line(2, "teologia toate"), line(3, "teologia toate tainic pre compl-")])
    got = {r.line_no: r.score for r in R.lexicon_score(ls, lexicon).collect()}
    assert got[0] == 0.8 and got[1] == 0.25 and got[2] is None and got[3] == 1.0


def test_cedillas_are_folded(spark):
    assert spark.createDataFrame([("Şi",)], "w string").select(R.folded(F.col("w")).alias("f")).first().f == "și"


def test_dictionaries(tmp_path):
    (tmp_path / "ro_RO.dic").touch()
    assert external.find_dictionary("ron", [tmp_path]) == "ro_RO"
    assert external.find_dictionary("deu", [tmp_path]) is None


def test_capabilities_are_gated(spark):
    for what in ("pdf", "ocr", "dictionary"):
        if not external.available(what):
            with pytest.raises(RuntimeError):
                external._need(what)
    with pytest.raises(ValueError):
        external.available("other")


def test_ocr_lines(spark):
    rows = [("b", 0, 0, "world", 50.0, 10.0, 80.0, 20.0, 90.0, 1, 1, 1), ("b", 0, 1, "hello", 10.0, 9.0, 40.0, 21.0, 90.0, 1, 1, 1), ("b", 0, 2, "noise", 0.0, 0.0, 5.0, 5.0, 10.0, 1, 1, 1), ("b", 0, 3, "next", 10.0, 30.0, 40.0, 40.0, -1.0, 1, 1, 2)]
    from quire import schema as S

    got = external.ocr_lines(spark.createDataFrame(rows, S.WORDS), 100.0, 100.0).orderBy("line_no").collect()
    assert [(r.spans[0].text, r.spans[0].size) for r in got] == [("hello world", 12.0), ("next", 10.0)]
    assert (got[0].x0, got[0].y0, got[0].x1, got[0].y1) == (10.0, 9.0, 80.0, 21.0)
