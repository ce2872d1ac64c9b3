import pytest
from pyspark.sql import functions as F

from quire.functions.spans import dominant_size, is_bold, is_italic, is_mono, is_superscript, label_from_spans, markers
from quire.operators import layout as A
from quire.operators import scan as B
from quire.operators import stats as T
from tests.helpers import line, lines, span


def stats(df, body=11.0, height=12.0, left=72.0):
    return df.withColumn("body_size", F.lit(body)).withColumn("line_height", F.lit(height)).withColumn("body_left", F.lit(left))


def found(spark, parts):
    df = lines(spark, [line(0, parts)])
    return [(m["i"], m["label"]) for m in df.select(markers().alias("m")).first()["m"]]


def test_markers(spark):
    fraction = [span("Positivism: "), span("5"), span("1", 7, 1, y=105), span("⁄"), span("2", 7)]
    assert found(spark, fraction) == []
    assert found(spark, [span("authority."), span("7", 7, 1, y=105), span(" One might")]) == [(1, "7")]
    assert found(spark, [span("authority."), span("7", 7, y=105), span(" One might")]) == [(1, "7")]
    assert found(spark, [span("from page 46", 9.5)]) == []
    assert found(spark, [span("word"), span("*", 7, 1, y=105), span("†‡", 7, 1, y=105), span("12*", 7, 1, y=105)]) == [(1, "*"), (3, "12*")]


def test_span_flags(spark):
    df = lines(spark, [line(0, [span("a", flags=1 | 2), span("bb", 9, flags=8 | 16), span("c", font="X-BoldOblique")])])
    got = df.select(*[F.transform("spans", f).alias(f.__name__) for f in (is_bold, is_italic, is_superscript, is_mono)], dominant_size().alias("d")).first()
    assert (got.is_bold, got.is_italic, got.is_superscript, got.is_mono, got.d) == ([False, True, True], [True, False, True], [True, False, False], [False, True, False], 9.0)


def test_label_from_spans(spark):
    df = lines(spark, [line(0, [span("3", 6, y=108), span(" See above", 9)]), line(1, "3 See above")])
    assert [r.x and tuple(r.x) for r in df.orderBy("line_no").select(label_from_spans().alias("x")).collect()] == [("3", " See above"), None]


def test_clean_lines(spark):
    df = lines(spark, [line(0, [span("a"), span("")]), line(1, [span("")]), line(2, "\x01\x02\x03x"), line(3, [span("s", 10.26)])])
    got = B.clean_lines(df).orderBy("line_no").collect()
    assert [(r.line_no, len(r.spans), r.size) for r in got] == [(0, 1, 11.0), (3, 1, 10.3)]


def test_merge_rows(spark):
    parts = ["transmisje ", "on-line", "i", "relacje", "na"]
    rows = [line(i, p, x0=72 + 60 * i, y0=464.7) for i, p in enumerate(parts)] + [line(5, "next", y0=480.0)]
    df = lines(spark, rows).withColumn("block_no", F.lit(0))
    got = B.merge_rows(df).withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), "")).orderBy("line_no").collect()
    assert [r.text for r in got] == ["transmisje on-line i relacje na", "next"]
    assert (got[0].x0, got[0].x1) == (72.0, 72 + 240 + 10.0)


def test_merge_rows_keeps_the_heads_height(spark):
    df = lines(spark, [line(i, "x", y0=y) for i, y in enumerate((10.0, 11.0, 12.0))]).withColumn("block_no", F.lit(0))
    assert B.merge_rows(df).count() == 2


@pytest.mark.parametrize("rows,is_map", [
    ([line(i, "ab", x0=72 + 40 * (i % 2)) for i in range(16)], False), ([line(i, "Town", x0=20 * (i % 15)) for i in range(30)], True),
    ([line(i, "A long title line here") for i in range(4)] + [line(i + 4, " ") for i in range(10)], False),
])
def test_map_pages(spark, rows, is_map):
    assert (B.map_pages(lines(spark, rows)).count() == 1) == is_map


def test_scan_plan(spark):
    pages = spark.createDataFrame([("b", p, 100.0, 100.0) for p in (0, 1, 2)], "book_id string, page_no long, width double, height double")
    images = spark.createDataFrame([("b", 0, 0, "i", "png", 0.0, 0.0, 100.0, 90.0, 900, 900), ("b", 1, 0, "j", "png", 0.0, 0.0, 100.0, 90.0, 900, 900)], "book_id string, page_no long, image_no int, image_id string, ext string, x0 double, y0 double, x1 double, y1 double, px_width int, px_height int")
    text = lines(spark, [line(0, "a long line of text", page=1), line(0, "a long line of text", page=2)])
    got = {r.page_no: r.action for r in B.scan_plan(pages, text, images, repair=True).collect()}
    assert got == {0: "ocr", 1: "repair", 2: "keep"}
    assert {r.action for r in B.scan_plan(pages, text, images, mode="force").collect()} == {"ocr"}
    read = lines(spark, [line(0, "words that were read on this page", page=0), line(0, "short", page=1)])
    plan = B.scan_plan(pages, text, images, mode="force")
    assert sorted((r.page_no, r.text) for r in B.with_ocr(text, plan, read).collect()) == [(0, "words that were read on this page"), (1, "a long line of text"), (2, "a long line of text")]
    assert [r.page_no for r in B.kept_images(images, pages, plan.where("page_no = 0")).collect()] == [1]


def test_stats(spark):
    df = lines(spark, [line(0, "Title", size=22), line(1, "body text here", x0=72.5), line(2, "more body text", x0=72.5), line(3, "xx", x0=90)])
    got = T.book_stats(df).first()
    assert (got.body_size, got.line_height, got.body_left) == (11.0, 12.0, 72.0)


@pytest.mark.parametrize("text,size,top,y0,h,near,want", [("5", 12, False, 602.0, 630.0, 575.0, True), ("2", 30, True, 20.0, 800.0, None, False)])
def test_folio(spark, text, size, top, y0, h, near, want):
    df = stats(lines(spark, [line(0, text, y0=y0, size=size, page_height=h)])).withColumn("repeats", F.lit(0)).withColumn("gap", F.lit(near).cast("double"))
    gap = F.col("y0") - F.col("gap") if near else F.col("gap")
    assert df.select(A.furniture_rule(top, gap).alias("f")).first()["f"] == want


def test_furniture_repeats_over_pages(spark):
    rows = []
    for p in range(4):
        rows += [line(0, "THE LONG ROAD", y0=40.0, page=p), *(line(i, f"Body line {i} of the page, with words.", y0=200.0 + 14 * i, page=p) for i in range(1, 6)), line(6, str(p + 10), y0=740.0, page=p)]
    df = lines(spark, rows)
    assert {r.line_no for r in A.strip_furniture(df, T.book_stats(df)).collect()} == {1, 2, 3, 4, 5}


def test_one_line_always_stays(spark):
    df = lines(spark, [line(0, "7", y0=40.0)])
    assert A.strip_furniture(df, T.book_stats(df)).count() == 1


def test_two_columns(spark):
    rows = [line(i, "x" * 40, x0=72 if i % 2 == 0 else 320, y0=100.0 + 14 * (i // 2), x1=280 if i % 2 == 0 else 520) for i in range(12)]
    got = A.reading_order(lines(spark, rows)).orderBy("pos").collect()
    assert [r.line_no for r in got] == [0, 2, 4, 6, 8, 10, 1, 3, 5, 7, 9, 11]


def test_line_in_the_gutter_once(spark):
    rows = [line(i, "x", x0=72 if i % 2 else 320, x1=280 if i % 2 else 520, y0=100.0 + i) for i in range(10)] + [line(10, "x", x0=300, x1=310, y0=150.0)]
    assert A.reading_order(lines(spark, rows)).count() == 11


def test_note_zone(spark):
    rows = [line(0, "A body line.", size=12, y0=100.0), line(1, "Another body line.", size=12, y0=120.0), line(2, "A quoted line", size=10, y0=600.0), line(3, "1 First note", size=10, y0=620.0), line(4, "2 Second note", size=10, y0=640.0)]
    df = stats(lines(spark, rows), body=12.0).withColumn("pos", F.col("line_no") + 1)
    assert [r.zone for r in A.note_zone(df).orderBy("pos").collect()] == ["body"] * 3 + ["note"] * 2


def test_note_zone_needs_a_body(spark):
    rows = [line(0, "Only body.", size=12), line(1, "1 Note", size=9, y0=600.0), line(2, "2 Note", size=9, y0=620.0)]
    df = stats(lines(spark, rows), body=12.0).withColumn("pos", F.col("line_no") + 1)
    assert {r.zone for r in A.note_zone(df).collect()} == {"body"}


def sections(spark, pages):
    rows = [line(n, text, size=size, page=p) for p, ls in enumerate(pages) for n, (text, size) in enumerate(ls)]
    df = stats(lines(spark, rows)).withColumn("pos", F.col("line_no") + 1).withColumn("zone", F.lit("body"))
    return [(r.page_no, r.text, r.zone) for r in A.endnote_sections(df).orderBy("page_no", "line_no").collect()]


def test_endnote_sections(spark):
    got = sections(spark, [[("text", 11), ("Notes", 13), ("1 a", 11), ("Big", 20)], [("2 b", 11), ("Next Chapter", 20), ("more", 11)], [("rest", 11)]])
    assert got == [(0, "text", "body"), (0, "1 a", "note"), (0, "Big", "note"), (1, "2 b", "note"), (1, "Next Chapter", "body"), (1, "more", "body"), (2, "rest", "body")]


def test_endnote_sections_open_again(spark):
    got = sections(spark, [[("Notes", 13)], [("a", 11)], [("Big", 20), ("Notes", 13), ("b", 11)], [("c", 11)]])
    assert [z for _, t, z in got if t in "abc"] == ["note"] * 3
    assert ("Big", "body") in [(t, z) for _, t, z in got]
