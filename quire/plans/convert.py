"""From lines to books: the stages composed into one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.spans import with_text
from quire.operators import chapters as C
from quire.operators.flow import drop_pages, flow, merge_headings, merge_paragraphs, page_breaks
from quire.operators.layout import analyze
from quire.operators.notes import in_label_order, parse_notes
from quire.operators.paragraphs import elements as build_elements
from quire.operators.roles import classify_pages, headless_contents
from quire.operators.scan import clean_lines, map_pages
from quire.operators.stats import book_stats
from quire.plans.shared import Stages
from quire.sinks.html import render_chapters


@dataclass(frozen=True)
class Options:
    """What a conversion may vary. profile: academic or general. order: columns or rows."""

    title: str = ""
    author: str = ""
    language: str = "en"
    profile: str = "academic"
    ocr: str = "auto"
    ocr_lang: str = "eng"
    dpi: int = 300
    repair_ocr: bool = False
    preserve_page_breaks: bool = False
    keep_print_nav: bool = False
    order: str = "columns"

    def __post_init__(self):
        for name, allowed in (("profile", ("academic", "general")), ("ocr", ("auto", "force", "off")), ("order", ("columns", "rows"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")


@dataclass(frozen=True)
class Books:
    """The tables of converted books."""

    elements: DataFrame
    chapters: DataFrame
    notes: DataFrame
    subheads: DataFrame
    pages: DataFrame
    books: DataFrame

    def html(self, language: str = "en", hrefs: DataFrame | None = None) -> DataFrame:
        return render_chapters(self.elements, self.chapters, self.notes, language, hrefs)

    def results(self) -> DataFrame:
        """One row for each book: title, author, and its numbers of pages, chapters, notes and images."""
        n = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
        out = self.books.join(n(self.pages, "pages"), "book_id", "left").join(n(self.chapters, "chapters"), "book_id", "left")
        out = out.join(n(self.notes, "footnotes"), "book_id", "left").join(n(self.elements.where("kind = 'image'"), "images"), "book_id", "left")
        return out.na.fill(0, ["pages", "chapters", "footnotes", "images"])


def convert(lines: DataFrame, options: Options = Options(), images: DataFrame | None = None, toc: DataFrame | None = None, meta: DataFrame | None = None) -> Books:
    """Convert books given as lines (schema LINES), with images, outline and metadata (book_id, title, author) where they are known.

    Steps that read a table twice would double the plan at every step, so their inputs are written to the shared folder.
    """
    save = Stages(lines.sparkSession, "convert").save
    academic = options.profile == "academic"
    text = clean_lines(lines)
    text = save(text.join(map_pages(text), ["book_id", "page_no"], "left_anti"))
    stats = save(book_stats(text))
    roles = save(classify_pages(text, stats, images))
    zoned = save(analyze(text, stats, options.order))
    body = zoned.where("zone = 'body'")
    if not options.keep_print_nav:
        body = body.join(headless_contents(body), ["book_id", "page_no"], "left_anti")
    notes = save(parse_notes(zoned.where("zone = 'note'")))
    pages = lines.groupBy("book_id", "page_no").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    rows = save(flow(build_elements(body, notes, academic), images, pages))
    if not options.keep_print_nav:
        rows = drop_pages(rows, roles)
    rows = save(merge_paragraphs(save(merge_headings(rows))))
    if options.preserve_page_breaks:
        rows = page_breaks(rows)
    rows, chapters = _split(rows, toc)
    rows, chapters = save(rows), save(chapters)
    notes = save(C.attach_notes(notes, chapters)).select("book_id", "ch", "page_no", "ord", "note_id", "label", "text")
    if not options.keep_print_nav:
        left = save(C.drop_print_nav(chapters))
        rows, notes = C.drop_front_lists(C.renumbered(rows, left)), C.renumbered(notes, left)
        rows, chapters = save(rows), C.renumbered(chapters, left)
    own = None
    if academic:
        rows, own = C.endnotes(rows)
        own = save(own)
        rows, subs = C.assign_nav(save(C.style_references(rows)))
        subs = save(subs)
    else:
        subs = C.subheads(rows).limit(0)
    rows = save(C.bind_notes(rows, notes, own))
    if own is not None:
        notes = notes.unionByName(own.join(notes.select("book_id", "ch", "note_id"), ["book_id", "ch", "note_id"], "left_anti").select(*notes.columns))
    notes = save(in_label_order(notes.where("trim(text) <> ''")))
    books = C.guess_title(rows).join(C.guess_author(rows), "book_id", "left")
    if meta is not None:
        given = meta.select("book_id", F.col("title").alias("t"), F.col("author").alias("a"))
        blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
        books = books.join(given, "book_id", "left").select("book_id", F.coalesce(blank("t"), "title").alias("title"), F.coalesce(blank("a"), "author").alias("author"))
    books = books.select("book_id", F.lit(options.title).alias("title") if options.title else F.col("title"), F.lit(options.author).alias("author") if options.author else F.coalesce("author", F.lit("")).alias("author"), F.lit(options.language).alias("language"))
    return Books(rows, chapters, notes, subs, pages, books)


def _split(rows: DataFrame, toc: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if toc is None:
        return C.split_by_headings(rows)
    usable = C.outline(toc).select("book_id").distinct()
    a, ca = C.split_by_outline(rows, toc)
    b, cb = C.split_by_headings(rows.join(usable, "book_id", "left_anti"))
    return a.unionByName(b), ca.unionByName(cb)


__all__ = ["Books", "Options", "convert", "with_text"]
