import pytest
from pyspark.sql import functions as F

from quire.operators import chapters as C
from quire.operators import flow as W
from quire.operators import notes as N
from quire.operators import paragraphs as G
from quire.operators import roles as O
from quire.operators import stats as T
from quire.operators.carry import previous, running_sum
from tests.helpers import element, elements, line, lines, span


def level(spark, text, size=12.0, body=12.0, bold=False):
    return spark.createDataFrame([(text, float(size), float(body), bold)], "text string, size double, body_size double, bold boolean").select(G.heading_level().alias("l")).first()["l"]


@pytest.mark.parametrize("text,size,body,bold,want", [
    ("1.Literature overview " + "." * 40, 12, 12, True, None), ("1.Literature overview", 20, 12, False, 1), ("Partea întâi", 11, 11, False, 1), ("I", 11, 11, True, 2), ("IV", 10.5, 11, False, 2),
    ("V. CUM TREBUIE CITITE", 13, 11, False, 1), ("RÉSUMÉ", 11, 11, False, 1), ("1.1. Hegemony and language", 12.8, 12, False, 3), ("plain words of a sentence", 12, 12, False, None),
    ("Bold words", 12, 12, True, 4), ("Bold words.", 12, 12, True, None), ("ALL CAPS HERE", 12, 12, False, 3), ("7", 12, 12, True, None), ("7", 24, 12, False, 1), ("", 20, 12, False, None), ("w " * 17, 30, 12, False, None),
])
def test_heading_level(spark, text, size, body, bold, want):
    assert level(spark, text, size, body, bold) == want


def test_merge_headings(spark):
    rows = [element(0, "heading", "2", 1, page=30), element(1, "heading", "Between East and West, fourteenth", 1, page=30), element(2, "heading", "century to 1774", 1, page=30), element(3, "paragraph", "text", page=30)]
    got = W.merge_headings(elements(spark, rows)).orderBy("ord").select(W.runs_text().alias("t")).collect()
    assert [r.t for r in got] == ["2 Between East and West, fourteenth century to 1774", "text"]


def test_numbered_headings_stay_apart(spark):
    rows = [element(0, "heading", "1.Literature overview", 1, 20), element(1, "heading", "1.1. Hegemony and language", 2, 20)]
    assert W.merge_headings(elements(spark, rows)).count() == 2


def test_division_label_takes_its_title(spark):
    rows = [element(0, "heading", "Partea întâi", 1, 11), element(1, "heading", "Cum se citesc", 1, 17.5), element(2, "heading", "textele vechi", 1, 17.5)]
    got = W.merge_headings(elements(spark, rows)).collect()
    assert len(got) == 1 and got[0].size == 17.5


def merged(spark, rows):
    got = W.merge_paragraphs(elements(spark, rows)).orderBy("page_no", "ord")
    return [r.t for r in got.select("page_no", "ord", W.runs_text().alias("t")).collect()]


def test_merge_paragraphs(spark):
    assert merged(spark, [element(0, "paragraph", "e compli-"), element(1, "paragraph", "cată, zice")]) == ["e complicată, zice"]
    assert merged(spark, [element(0, "paragraph", "First paragraph ends here"), element(1, "paragraph", "Second paragraph starts here.")]) == ["First paragraph ends here", "Second paragraph starts here."]
    assert merged(spark, [element(0, "paragraph", "would perhaps,"), element(0, "paragraph", "be made", page=1)]) == ["would perhaps, be made"]
    assert merged(spark, [element(0, "paragraph", "on one page"), element(1, "paragraph", "in lower case")]) == ["on one page", "in lower case"]
    assert merged(spark, [element(0, "paragraph", "a turn"), element(0, "paragraph", "goes on", page=1), element(1, "paragraph", "and on", page=1)]) == ["a turn goes on and on"]
    assert merged(spark, [element(0, "paragraph", "a turn."), element(0, "paragraph", "goes on", page=1)]) == ["a turn.", "goes on"]
    assert merged(spark, [element(0, "paragraph", "a turn"), element(0, "heading", "H", 1, page=1), element(1, "paragraph", "goes on", page=1)]) == ["a turn", "H", "goes on"]


def test_carry(spark):
    df = elements(spark, [element(k, "paragraph", str(p * 10 + k), page=p) for p in range(3) for k in range(3)])
    got = running_sum(df, F.col("ord"), "s").orderBy("page_no", "ord").collect()
    assert [r.s for r in got] == [0, 1, 3, 3, 4, 6, 6, 7, 9]
    got = previous(df.withColumn("t", W.runs_text()), ["t"]).orderBy("page_no", "ord").collect()
    assert [r.p_t for r in got] == [None, "0", "1", "2", "10", "11", "12", "20", "21"]


def test_page_breaks(spark):
    got = W.page_breaks(elements(spark, [element(0, "paragraph", "a"), element(0, "paragraph", "b", page=2)])).where("kind = 'page_break'").collect()
    assert [(r.page_no, r.anchor, r.level) for r in got] == [(2, "page-3", 3)]


def test_split_by_headings(spark):
    rows, chapters = C.split_by_headings(elements(spark, [element(0, "paragraph", "p"), element(1, "heading", "Introduction", 1), element(2, "paragraph", "q"), element(3, "heading", "Sub", 2)]))
    assert [r.title for r in chapters.orderBy("ch").collect()] == ["Front Matter", "Introduction"]
    assert [r.ch for r in rows.orderBy("ord").collect()] == [0, 1, 1, 1]


def test_print_nav_is_dropped(spark):
    _, chapters = C.split_by_headings(elements(spark, [element(k, "heading", t, 1, page=k) for k, t in enumerate(("One", "Contents", "Two"))]))
    left = C.drop_print_nav(chapters)
    assert [(r.ch, r.title) for r in C.renumbered(chapters, left).orderBy("ch").collect()] == [(0, "One"), (1, "Two")]
    notes = spark.createDataFrame([("b", p, 0, f"n{p}-1", "1", "t") for p in range(3)], "book_id string, page_no long, ord int, note_id string, label string, text string")
    attached = C.renumbered(C.attach_notes(notes, chapters), left)
    assert sorted((r.ch, r.note_id) for r in attached.collect()) == [(0, "n0-1"), (1, "n2-1")]


def test_outline(spark):
    toc = spark.createDataFrame([("b", 0, 1, "One", 2), ("b", 1, 2, "Inner", 2), ("b", 2, 1, "Two", 4), ("c", 0, 1, "1", 1), ("c", 1, 1, "2", 2)], "book_id string, ord int, level int, title string, page long")
    rows, chapters = C.split_by_outline(elements(spark, [element(0, "paragraph", str(p), page=p) for p in range(5)]), toc)
    assert [(r.ch, r.title) for r in chapters.orderBy("ch").collect()] == [(0, "Front Matter"), (1, "One"), (2, "Two")]
    assert [r.ch for r in rows.orderBy("page_no").collect()] == [0, 1, 1, 2, 2]
    assert C.outline(toc.where("book_id = 'c'")).count() == 0


def chaptered(spark, rows):
    return elements(spark, rows).withColumn("ch", F.lit(0).cast("long"))


def test_front_lists(spark):
    rows = [element(0, "heading", "Front", 1), element(1, "heading", "List of Maps", 2), element(2, "paragraph", "1. Map"), element(3, "heading", "Inner", 3), element(4, "heading", "Next", 2), element(5, "paragraph", "kept")]
    assert [r.ord for r in C.drop_front_lists(chaptered(spark, rows)).orderBy("ord").collect()] == [0, 4, 5]


def test_references(spark):
    rows = [element(0, "heading", "References", 2), element(1, "paragraph", "A"), element(2, "heading", "Annex", 2), element(3, "paragraph", "B")]
    assert [r.kind for r in C.style_references(chaptered(spark, rows)).orderBy("ord").collect()] == ["heading", "reference", "heading", "paragraph"]


def test_endnotes(spark):
    rows = [element(0, "heading", "One", 1), element(1, "paragraph", "text"), element(2, "heading", "Notes", 2), element(3, "paragraph", "1. Human Know-"), element(4, "paragraph", "ledge"), element(5, "paragraph", "2. Other"), element(6, "heading", "End", 2), element(7, "paragraph", "3. not a note")]
    body, notes = C.endnotes(chaptered(spark, rows))
    assert [r.ord for r in body.orderBy("ord").collect()] == [0, 1, 6, 7]
    assert [(r.note_id, r.text) for r in notes.orderBy("ord").collect()] == [("en0-1", "Human Knowledge"), ("en0-2", "Other")]
    body, notes = C.endnotes(chaptered(spark, [element(0, "heading", "Notes", 1), element(1, "paragraph", "no label")]))
    assert body.count() == 2 and notes.count() == 0


def test_nav(spark):
    rows = [element(0, "heading", "Top", 1), element(1, "heading", "1.2 Data", 2), element(2, "paragraph", "See section 1.2, or Sec. 9 there."), element(3, "caption", "none")]
    got, subs = C.assign_nav(chaptered(spark, rows))
    assert [(r.anchor, r.title, r.number) for r in subs.collect()] == [("sec-0-0", "1.2 Data", "1.2")]
    para = got.where("ord = 2").first()
    assert [(r.text, r.href) for r in para.runs] == [("See ", None), ("section 1.2", "#sec-0-0"), (", or Sec. 9 there.", None)]
    assert got.where("ord = 1").first().anchor == "sec-0-0"


def test_bind_notes(spark):
    df = chaptered(spark, [element(0, "paragraph", "x")])
    run = lambda label, ref: F.struct(F.lit(label), F.lit(False), F.lit(False), F.lit(False), F.lit(ref), F.lit(None).cast("string")).cast(df.schema["runs"].dataType.elementType.simpleString())
    df = df.withColumn("runs", F.array(run("1", "n0-1"), run("2", "n9-2"), run("3", "n9-3"), run("4", "n9-4"), run("5", "n9-5")))
    notes = spark.createDataFrame([("b", 0, 0, 0, "n0-1", "1", "a"), ("b", 0, 0, 1, "n0-2", "2", "b"), ("b", 0, 1, 0, "n1-3", "3", "c"), ("b", 0, 2, 0, "n2-3", "3", "d")], "book_id string, ch long, page_no long, ord int, note_id string, label string, text string")
    own = spark.createDataFrame([("b", 0, 5, 0, "en0-5", "5", "e")], notes.schema)
    got = C.bind_notes(df, notes, own).first().runs
    assert [(r.noteref, r.sup) for r in got] == [("n0-1", False), ("n0-2", False), (None, True), (None, True), ("en0-5", False)]


def test_title_and_author(spark):
    rows = chaptered(spark, [element(0, "heading", "A. Writer", 2, 14), element(1, "heading", "The Book", 1, 30), element(2, "heading", "A Study", 2, 18), element(3, "paragraph", "© Keith Hitchins 2014")])
    assert C.guess_title(rows).first().title == "The Book: A Study"
    assert C.guess_author(rows).first().author == "Keith Hitchins"
    plain = chaptered(spark, [element(0, "paragraph", "p")])
    assert C.guess_title(plain).first().title == "Untitled" and C.guess_author(plain).first().author == ""


def parsed(spark, rows):
    return [(r.label, r.text) for r in N.parse_notes(lines(spark, rows).withColumn("pos", F.col("line_no") + 1)).orderBy("page_no", "ord").collect()]


def test_parse_notes(spark):
    rows = [line(0, "12 See pp. 5", x0=72), line(1, "and more at", x0=86), line(2, "113, vol. 3, pp. 116-117", x0=72), line(3, "13 Next", x0=72)]
    assert parsed(spark, rows) == [("12", "See pp. 5 and more at 113, vol. 3, pp. 116-117"), ("13", "Next")]
    assert parsed(spark, [line(0, "tail of a note"), line(1, "3 c"), line(2, "9 not in order"), line(3, "4 d"), line(4, "* star")]) == [("3", "c 9 not in order"), ("4", "d"), ("*", "star")]


def test_runs(spark):
    rows = [line(0, [span("The "), span("bold", flags=16), span(" know-")], y0=100), line(1, [span("ledge, a"), span("2", 7, 1, y=105), span(" note")], y0=112)]
    df = lines(spark, rows).withColumn("pos", F.col("line_no") + 1)
    got = G.elements(df.join(T.book_stats(df), "book_id")).collect()
    assert len(got) == 1 and got[0].kind == "paragraph"
    assert [(r.text, r.bold, r.noteref) for r in got[0].runs] == [("The ", False, None), ("bold", True, None), (" knowledge, a", False, None), ("2", False, "n0-2"), (" note", False, None)]


def test_embedded_markers_in_runs(spark):
    df = lines(spark, [line(0, "A word1 and word7 too.")]).withColumn("pos", F.col("line_no") + 1)
    notes = spark.createDataFrame([("b", 0, "1")], "book_id string, page_no long, label string")
    got = G.elements(df.join(T.book_stats(df), "book_id"), notes).first()
    assert [(r.text, r.noteref) for r in got.runs] == [("A word", None), ("1", "n0-1"), (" and word7 too.", None)]


def test_kinds(spark):
    rows = [line(0, "A body line that goes on for a while to the right edge of it", y0=100), line(1, "and its second line that goes on a while, too, up to the edge", y0=112), line(2, "Figure 3. A caption", y0=150), line(3, "quoted words set in", x0=110, y0=200), line(4, "from the left margin", x0=110, y0=212), line(5, "Data", y0=260, size=16)]
    df = lines(spark, rows).withColumn("pos", F.col("line_no") + 1)
    got = G.elements(df.join(T.book_stats(df), "book_id")).orderBy("ord").collect()
    assert [(r.kind, r.level) for r in got] == [("paragraph", 0), ("caption", 0), ("blockquote", 0), ("heading", 2)]
    general = G.elements(df.join(T.book_stats(df), "book_id"), academic=False).collect()
    assert {r.kind for r in general} == {"paragraph", "heading"}


def test_tables(spark):
    rows = [[(72, "Name"), (200, "Size")], [(73, "a"), (201, "1")], [(72, "b"), (199, "2")]]
    cases = [
        (rows, [["Name", "Size"], ["a", "1"], ["b", "2"]]), (rows[:2], None), ([[(72, "x")] * 1, *rows], None), ([[(72, "w " * 13), (200, "w " * 13)]] * 3, None),
        ([[(72 + 20 * i, "a"), (200 + 20 * i, "b")] for i in range(3)], None),
        ([*rows, [(72, "c"), (200, "3"), (330, "note")]], None), ([*rows[:2], [(72, "a  b"), (74, "c")], rows[2]], None),
        ([*rows, [(72, "x"), (200, "")], rows[0]], [["Name", "Size"], ["a", "1"], ["b", "2"], ["x", ""], ["Name", "Size"]]),
    ]
    df = spark.createDataFrame([(k, [[(float(x), t) for x, t in line] for line in ls]) for k, (ls, _) in enumerate(cases)], "k int, ls array<array<struct<x: double, t: string>>>")
    got = {r.k: r.table_rows for r in G.table_rows(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases) if want}


def test_table_elements(spark):
    rows = [line(i, [span(f"r{i}"), span(f"v{i}", x0=200.0)], x1=260.0) for i in range(3)]
    df = lines(spark, rows).withColumn("pos", F.col("line_no") + 1)
    got = G.elements(df.join(T.book_stats(df), "book_id")).collect()
    assert [(r.kind, r.table_rows) for r in got] == [("table", [["r0", "v0"], ["r1", "v1"], ["r2", "v2"]])]


def roles(spark, rows):
    df = lines(spark, rows)
    return {r.page_no: (r.page_type, r.confidence) for r in O.classify_pages(df, T.book_stats(df)).collect()}


def test_roles(spark):
    contents = [line(0, "Contents", size=18)] + [line(i, f"Chapter {i} ........ {i}") for i in range(1, 11)]
    prose = [line(i, "plain words of an ordinary page", page=1) for i in range(12)]
    opening = [line(0, "1. Introduction", size=18, page=2)] + [line(i, "plain words of an ordinary page", page=2) for i in range(1, 9)]
    late = [line(0, "CUPRINS", page=371)] + [line(i, f"Cap. {i} ...... {i}", page=371) for i in range(1, 9)]
    got = roles(spark, contents + prose + opening + late)
    assert got[0][0] == "contents" and got[1] == ("prose", 0.55) and got[2][0] == "chapter_opening"
    assert got[371][0] == "contents" and got[371][1] >= 0.8


def test_contents_by_shape(spark):
    got = roles(spark, [line(i, f"{i} .... {i}", page=1) for i in range(10)])
    assert got[1] == ("contents", pytest.approx(0.8))


def test_headless_contents(spark):
    rows = [line(i, t, x0=72 + 100 * (i % 3), page=2) for i, t in enumerate(["List of maps", "12", "Further reading", "14", "Acknowledgments", "16", "I", "18", "II", "20", "III", "22", "IV", "24", "V"])]
    assert O.headless_contents(lines(spark, rows)).count() == 1
    poem = [line(i, "word", x0=72 + 100 * (i % 3), page=2) for i in range(12)]
    assert O.headless_contents(lines(spark, poem)).count() == 0
