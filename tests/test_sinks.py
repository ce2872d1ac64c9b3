import io
import zipfile

from pyspark.sql import functions as F

from quire.plans.convert import Options, convert
from quire.sinks import audit as U
from quire.sinks import epub as E
from quire.sinks import html as H
from tests.helpers import element, elements, line, span


def rendered(spark, rows):
    df = elements(spark, rows).withColumn("ch", F.lit(0).cast("long"))
    return [r.html for r in H.render_elements(df).orderBy("page_no", "cls", "ord").collect()]


def test_headings(spark):
    assert rendered(spark, [element(0, "heading", "2. Methodological framework of research", 1)]) == ['<h1><span class="chnum">2</span><span class="chtitle">Methodological framework of research</span></h1>\n']
    assert rendered(spark, [element(0, "heading", "Chapter One", 1)]) == ["<h1>Chapter One</h1>\n"]
    assert rendered(spark, [element(0, "heading", "Book Club", 1)]) == ["<h1>Book Club</h1>\n"]
    assert rendered(spark, [element(0, "heading", "chapter 3: The Aims & Ends", 1)]) == ['<h1><span class="chnum">Chapter 3</span><span class="chtitle">The Aims &amp; Ends</span></h1>\n']
    assert rendered(spark, [element(0, "heading", "Deep", 7)]) == ["<h4>Deep</h4>\n"]


def test_opening_paragraph(spark):
    got = rendered(spark, [element(0, "heading", "One", 1), element(1, "paragraph", "It was the best of times, it was"), element(2, "paragraph", "next")])
    assert got[1] == '<p class="opening"><span class="dropcap">I</span><span class="lead">t was</span> the best of times, it was</p>\n'
    assert got[2] == "<p>next</p>\n"
    assert rendered(spark, [element(0, "heading", "One", 1), element(1, "paragraph", "lower case start")])[1] == '<p class="noindent">lower case start</p>\n'
    assert rendered(spark, [element(0, "heading", "One", 2), element(1, "paragraph", "It was")])[1] == '<p class="noindent">It was</p>\n'
    assert rendered(spark, [element(0, "heading", "One", 1), element(1, "paragraph", "“It was so”")])[1].startswith('<p class="opening">“<span class="dropcap">I</span>')


def test_other_elements(spark):
    got = rendered(spark, [element(0, "blockquote", "q"), element(1, "caption", "c"), element(2, "reference", "r"), element(3, "page_break", "", 4), element(4, "image", "")])
    assert got == ["<blockquote><p>q</p></blockquote>\n", '<p class="caption">c</p>\n', '<p class="reference">r</p>\n', '<span epub:type="pagebreak" role="doc-pagebreak" id="page-4" title="4"></span>\n', ""]


def book(spark):
    rows = []
    for p, title in enumerate(("Chapter One", "Chapter Two", "Chapter Three")):
        rows.append(line(0, "THE LONG ROAD", y0=40.0, page=p, x0=250.0))
        rows.append(line(1, title, size=22, y0=120.0, page=p))
        for i in range(2, 12):
            last = [span("It ends with a mark"), span(str(p + 1), 7, 1, y=305), span(" here.")] if i == 11 else f"Plain line {i} of the text, which fills the measure of the page well."
            rows.append(line(i, last, y0=140.0 + 14 * i, page=p, x1=430.0))
        rows.append(line(12, f"{p + 1} A note on page {p + 1}.", size=8, y0=640.0, page=p))
        rows.append(line(13, str(p + 10), y0=740.0, page=p, x0=300.0))
    from quire import schema as S

    return spark.createDataFrame(rows, S.LINES)


def test_convert_end_to_end(spark):
    made = convert(book(spark))
    row = made.results().first()
    assert (row.pages, row.chapters, row.footnotes, row.title) == (3, 3, 3, "Chapter One")
    html = made.html().orderBy("ch").collect()
    text = "".join(r.html for r in html)
    assert "THE LONG ROAD" not in text and text.count("noteref") == 6 and 'id="n0-1"' in text
    audit = U.audit(made.html().select("book_id", F.concat(F.lit("EPUB/chap_"), F.col("ch").cast("string"), F.lit(".xhtml")).alias("name"), "html")).first()
    assert audit.ok and audit.noterefs == audit.notes == 3 and audit.dead_links == [] and audit.furniture == []
    packed = E.epubs(made.books, made.html(), made.subheads).first()
    with zipfile.ZipFile(io.BytesIO(packed.epub)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        parts = spark.createDataFrame([("b", n, bytearray(z.read(n))) for n in z.namelist()], "book_id string, part string, content binary")
    again = U.epub_audit(parts).first()
    assert again.chapters == 3 and again.malformed == [] and again.stylesheet_linked and not again.has_cover and not again.ok
    report = U.report(U.epub_audit(parts)).first().report
    assert "cover      MISSING" in report and "ISSUES FOUND" in report
    assert '"chapters":3' in U.as_json(U.epub_audit(parts)).first().json


def test_convert_with_options(spark):
    meta = spark.createDataFrame([("b", "Given", " ")], "book_id string, title string, author string")
    made = convert(book(spark), Options(profile="general", preserve_page_breaks=True, author="Someone"), meta=meta)
    row = made.books.first()
    assert (row.title, row.author) == ("Given", "Someone")
    assert made.elements.where("kind = 'page_break'").count() == 2


def test_dead_links_are_found(spark):
    html = '<p>text<sup><a epub:type="noteref" id="a-ref" href="#a">1</a></sup></p><p>12</p><p>1984</p><sup>2</sup><table ><img src="images/i.png"/><section><aside epub:type="footnote" id="b"></aside></section>'
    chapters = spark.createDataFrame([("b", "EPUB/chap_000.xhtml", html)], "book_id string, name string, html string")
    parts = spark.createDataFrame([("b", "EPUB/style.css"), ("b", "EPUB/cover.png")], "book_id string, part string")
    got = U.audit(chapters, parts=parts).first()
    assert got.dead_links == ["EPUB/chap_000.xhtml#a"] and got.furniture == ["EPUB/chap_000.xhtml: 12"] and got.unlinked_markers == 1 and got.tables == 1
    assert got.missing_images == ["EPUB/chap_000.xhtml -> images/i.png"] and got.dead_internal_links == ["EPUB/chap_000.xhtml#a"] and not got.ok


def test_page_list_is_dropped(spark):
    nav = '<nav epub:type="toc">a</nav>\n<nav epub:type="page-list"><ol>\n</ol></nav><p/>'
    assert spark.createDataFrame([(nav,)], "n string").select(E.without_page_list("n").alias("r")).first().r == '<nav epub:type="toc">a</nav><p/>'


def test_stream(spark, tmp_path):
    from quire import schema as S
    from quire.streaming.ingest import stream_books

    book(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream_books(spark, str(tmp_path / "in"), S.LINES, lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/chapters")).count() == 3


def test_command_line():
    from quire.cli import parser

    args = parser().parse_args(["convert", "in", "-o", "out", "--source", "pages", "--profile", "general", "--keep-print-nav"])
    assert args.profile == "general" and args.keep_print_nav and args.dpi == 300
