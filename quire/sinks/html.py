"""Chapters as XHTML, rendered with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import escape, quoted, strip
from quire.operators.flow import runs_text

_CH = ("book_id", "ch")
_ORDER = ("page_no", "cls", "ord")

STYLESHEET = """@namespace epub "http://www.idpf.org/2007/ops";
body { margin: 0 4%; line-height: 1.45; text-align: justify; hyphens: auto; }
p { margin: 0; text-indent: 1.3em; }
p.noindent, p.opening, p.caption { text-indent: 0; }
p.caption { font-size: 0.85em; margin: 0.6em 0; }
p.reference { text-indent: -1.5em; margin-left: 1.5em; }
h1, h2, h3, h4 { text-align: left; hyphens: none; }
.chnum, .chtitle { display: block; }
.dropcap { float: left; font-size: 3em; line-height: 0.9; }
.lead { font-variant: small-caps; }
blockquote { margin: 0.8em 2em; }
table { border-collapse: collapse; }
th, td { border: 1px solid; padding: 0.2em 0.4em; }
.dinkus { text-align: center; text-indent: 0; }
aside.footnote { font-size: 0.85em; }
"""


def render_runs(runs) -> Column:
    def one(r):
        text = escape(r["text"])
        ref = escape(r["noteref"])
        return (
            F.when(r["noteref"].isNotNull(), F.concat(F.lit('<sup><a class="noteref" epub:type="noteref" id="'), ref, F.lit('-ref" href="#'), ref, F.lit('">'), text, F.lit("</a></sup>")))
            .when(r["href"].isNotNull(), F.concat(F.lit("<a href="), quoted(r["href"]), F.lit(">"), text, F.lit("</a>")))
            .when(r["sup"], F.concat(F.lit("<sup>"), text, F.lit("</sup>")))
            .when(r["bold"] & r["italic"], F.concat(F.lit("<strong><em>"), text, F.lit("</em></strong>")))
            .when(r["bold"], F.concat(F.lit("<strong>"), text, F.lit("</strong>")))
            .when(r["italic"], F.concat(F.lit("<em>"), text, F.lit("</em>")))
            .otherwise(text)
        )

    return F.array_join(F.transform(runs, one), "")


def chapter_title_parts(text) -> Column:
    """struct(label, title) of a numbered chapter heading, or null."""
    m = lambda p, i: F.regexp_extract(text, p, i)
    named = F.regexp_like(text, F.lit(P.CHAPTER_TITLE))
    title = strip(m(P.CHAPTER_TITLE, 3))
    return F.when(named, F.when(title != "", F.struct(F.concat(F.initcap(m(P.CHAPTER_TITLE, 1)), F.lit(" "), m(P.CHAPTER_TITLE, 2)).alias("label"), title.alias("title")))).when(
        F.regexp_like(text, F.lit(P.NUMBER_TITLE)), F.struct(m(P.NUMBER_TITLE, 1).alias("label"), strip(m(P.NUMBER_TITLE, 2)).alias("title"))
    )


def render_heading(level="level", anchor="anchor", runs="runs") -> Column:
    n = F.least(F.greatest(F.col(level), F.lit(1)), F.lit(4)).cast("string")
    text = strip(runs_text(runs))
    ident = F.when(F.coalesce(F.col(anchor), F.lit("")) != "", F.concat(F.lit(" id="), quoted(F.col(anchor)))).otherwise("")
    parts = chapter_title_parts(text)
    plain = F.concat(F.lit("<h"), n, ident, F.lit(">"), escape(text), F.lit("</h"), n, F.lit(">\n"))
    two = F.concat(F.lit("<h1"), ident, F.lit('><span class="chnum">'), escape(parts["label"]), F.lit('</span><span class="chtitle">'), escape(parts["title"]), F.lit("</span></h1>\n"))
    return F.when((n == "1") & parts.isNotNull(), two).otherwise(plain)


OPENING = rf"(?Us)^([{P.LEAD_PUNCTUATION}]*)(\p{{Lu}})(\w*(?:\s+\w+)?)(.*)$"


def split_opening(runs="runs") -> Column:
    """struct(prefix, cap, lead, tail) of a plain first run that begins with a capital and a lead of 1 to 24 characters, or null."""
    first = F.get(runs, F.lit(0))
    plain = first["noteref"].isNull() & ~first["sup"] & ~first["bold"] & ~first["italic"]
    g = lambda i: F.regexp_extract(first["text"], OPENING, i)
    fits = plain & F.regexp_like(first["text"], F.lit(OPENING)) & F.length(g(3)).between(1, 24)
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(g(1).alias("prefix"), g(2).alias("cap"), g(3).alias("lead"), g(4).alias("tail")))


def render_opening(runs="runs") -> Column:
    """A chapter's first paragraph with a drop cap, which leading punctuation precedes; null if it does not fit."""
    s = split_opening(runs)
    rest = F.concat(escape(s["tail"]), render_runs(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1)))))
    return F.when(s.isNotNull(), F.concat(F.lit('<p class="opening">'), escape(s["prefix"]), F.lit('<span class="dropcap">'), escape(s["cap"]), F.lit('</span><span class="lead">'), escape(s["lead"]), F.lit("</span>"), rest, F.lit("</p>\n")))


def render_elements(elements: DataFrame, hrefs: DataFrame | None = None) -> DataFrame:
    """elements with html. hrefs: image_id, image_href. A heading before a paragraph takes its indent; a level-1 one gives it a drop cap."""
    w = Window.partitionBy(*_CH).orderBy(*_ORDER)
    before, level = F.lag("kind").over(w), F.lag("level").over(w)
    rows = elements.withColumn("_h", F.coalesce(before == "heading", F.lit(False))).withColumn("_h1", F.coalesce((before == "heading") & (level <= 1), F.lit(False)))
    rows = rows.withColumn("image_href", F.lit(None).cast("string")) if hrefs is None else rows.join(hrefs, "image_id", "left")
    body = render_runs("runs")
    wrap = lambda a, b: F.concat(F.lit(a), body, F.lit(b))
    row = lambda r, i: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.when(i == 0, F.concat(F.lit("<th>"), escape(c), F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), escape(c), F.lit("</td>")))), ""), F.lit("</tr>"))
    number = F.when(F.col("level") > 0, F.col("level").cast("string")).otherwise("")
    html = (
        F.when(F.col("kind") == "page_break", F.concat(F.lit('<span epub:type="pagebreak" role="doc-pagebreak" id='), quoted(F.coalesce("anchor", F.concat(F.lit("page-"), number))), F.lit(" title="), quoted(number), F.lit("></span>\n")))
        .when(F.col("kind") == "heading", render_heading())
        .when(F.col("kind") == "image", F.coalesce(F.concat(F.lit('<div class="image"><img src='), quoted(F.col("image_href")), F.lit(' alt="figure"/></div>\n')), F.lit("")))
        .when(F.col("kind") == "blockquote", wrap("<blockquote><p>", "</p></blockquote>\n"))
        .when(F.col("kind") == "caption", wrap('<p class="caption">', "</p>\n"))
        .when(F.col("kind") == "reference", wrap('<p class="reference">', "</p>\n"))
        .when(F.col("kind") == "table", F.concat(F.lit('<div class="table-wrap"><table>\n'), F.array_join(F.transform("table_rows", row), "\n"), F.lit("\n</table></div>\n")))
        .when(F.col("_h1") & split_opening().isNotNull(), render_opening())
        .when(F.col("_h"), wrap('<p class="noindent">', "</p>\n"))
        .otherwise(wrap("<p>", "</p>\n"))
    )
    return rows.withColumn("html", html).drop("_h", "_h1", "image_href")


def render_footnotes(notes: DataFrame) -> DataFrame:
    """book_id, ch, html of each chapter's notes (with place): a section of asides with links back."""
    ident, label = escape(F.coalesce("note_id", F.lit(""))), escape(F.when(F.coalesce("label", F.lit("")) == "", "*").otherwise(F.col("label")))
    aside = F.concat(F.lit('<aside class="footnote" epub:type="footnote" id="'), ident, F.lit('"><p><a href="#'), ident, F.lit('-ref">'), label, F.lit(".</a> "), escape("text"), F.lit("</p></aside>\n"))
    made = notes.withColumn("aside", aside).groupBy(*_CH).agg(F.array_sort(F.collect_list(F.struct("place", "aside"))).alias("x"))
    head = f'<section class="footnotes" epub:type="footnotes">\n<p class="dinkus">{P.DINKUS}</p>\n<h2>Notes</h2>\n'
    return made.select(*_CH, F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["aside"]), ""), F.lit("</section>\n")).alias("notes_html"))


def render_chapters(elements: DataFrame, chapters: DataFrame, notes: DataFrame, language: str = "en", hrefs: DataFrame | None = None) -> DataFrame:
    """book_id, ch, title, html: one XHTML document for each chapter."""
    body = render_elements(elements, hrefs).groupBy(*_CH).agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "html"))).alias("x"))
    body = body.select(*_CH, F.array_join(F.transform("x", lambda x: x["html"]), "").alias("body"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang='), quoted(F.lit(language)), F.lit(" lang="), quoted(F.lit(language)),
        F.lit('>\n<head>\n<meta charset="utf-8"/>\n<title>'), escape(F.when(F.col("title") == "", "Chapter").otherwise(F.col("title"))), F.lit('</title>\n<link rel="stylesheet" type="text/css" href="style.css"/>\n</head>\n<body>\n'),
    )
    rows = chapters.join(body, list(_CH)).join(render_footnotes(notes), list(_CH), "left")
    return rows.select(*_CH, "title", F.concat(head, F.col("body"), F.coalesce("notes_html", F.lit("")), F.lit("</body>\n</html>\n")).alias("html"))
