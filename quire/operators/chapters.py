"""Chapters: split by outline or headings, notes attached by page range, lists dropped, references and links marked, titles guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions import patterns as P
from quire.functions.text import dehyphenated, n_words, strip
from quire.operators.carry import running_sum
from quire.operators.flow import runs_text

_CH = ("book_id", "ch")
_ORDER = ("page_no", "cls", "ord")
FRONT = "Front Matter"


def _like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def split_by_headings(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with ch (from 0), and chapters book_id, ch, title, start_page, end_page (the next one's start): a chapter begins at each heading of the book's least level."""
    rows = elements.withColumn("text", strip(runs_text()))
    heads = rows.where("kind = 'heading'").groupBy("book_id").agg(F.min("level").alias("split"))
    first = rows.groupBy("book_id").agg(F.min(F.struct(*_ORDER)).alias("first"))
    rows = rows.join(heads, "book_id", "left").join(first, "book_id")
    is_split = F.coalesce((F.col("kind") == "heading") & (F.col("level") == F.col("split")), F.lit(False))
    rows = rows.withColumn("is_split", is_split)
    starts = F.col("is_split") & (F.struct(*_ORDER) != F.col("first"))
    rows = running_sum(rows, starts.cast("int"), "ch")
    chapters = rows.groupBy(*_CH).agg(F.min_by(F.when(F.col("is_split"), F.col("text")), F.struct(*_ORDER)).alias("t"), F.min("page_no").alias("start_page"))
    title = F.when(F.coalesce("t", F.lit("")) != "", F.col("t")).when(F.col("ch") == 0, FRONT).otherwise(F.concat(F.lit("Chapter "), (F.col("ch") + 1).cast("string")))
    end = F.lead("start_page").over(Window.partitionBy("book_id").orderBy("ch"))
    return rows.drop("split", "first", "is_split", "text"), chapters.select(*_CH, title.alias("title"), "start_page", end.alias("end_page"))


def outline(toc: DataFrame) -> DataFrame:
    """book_id, start_page (from 0), end_page (open on the last), title of the outline's top entries; books without a usable outline have no rows.

    An outline needs two entries, two of its top level, and a top title that is more than a number. Of entries with one
    start page all but the last by title get an empty range.
    """
    rows = toc.where("page >= 1")
    book = Window.partitionBy("book_id")
    rows = rows.withColumn("n", F.count("*").over(book)).withColumn("top", F.min("level").over(book)).where("n >= 2 and level = top")
    rows = rows.withColumn("tops", F.count("*").over(book)).withColumn("named", F.max((~_like(strip(F.col("title")), r"^\d{1,3}$")).cast("int")).over(book)).where("tops >= 2 and named = 1")
    order = book.orderBy("page", "t", "ord")
    rows = rows.withColumn("t", strip(F.col("title")))
    return rows.select("book_id", F.row_number().over(order).alias("i"), (F.col("page") - 1).alias("start_page"), (F.lead("page").over(order) - 1).alias("end_page"), "t").select(
        "book_id", "i", "start_page", "end_page", F.when(F.col("t") == "", F.concat(F.lit("Chapter "), F.col("i").cast("string"))).otherwise(F.col("t")).alias("title")
    )


def split_by_outline(elements: DataFrame, toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with ch and chapters, for books with an outline: pages of a range are its chapter, pages before the first are front matter."""
    ranges = outline(toc)
    front = ranges.groupBy("book_id").agg(F.min("start_page").alias("end_page")).select("book_id", F.lit(0).alias("i"), F.lit(-1).cast("long").alias("start_page"), "end_page", F.lit(FRONT).alias("title"))
    ranges = ranges.unionByName(front).withColumnRenamed("book_id", "b")
    within = (F.col("book_id") == F.col("b")) & (F.col("page_no") >= F.col("start_page")) & (F.col("end_page").isNull() | (F.col("page_no") < F.col("end_page")))
    rows = elements.join(ranges, within)
    used = rows.groupBy("book_id", "i").agg(F.min("title").alias("title"), F.min("start_page").alias("start_page"), F.min("end_page").alias("end_page"))
    used = used.withColumn("ch", (F.row_number().over(Window.partitionBy("book_id").orderBy("i")) - 1).cast("long"))
    rows = rows.drop("b", "start_page", "end_page", "title").join(used.select("book_id", "i", "ch"), ["book_id", "i"]).drop("i")
    return rows, used.select(*_CH, "title", F.greatest("start_page", F.lit(0).cast("long")).alias("start_page"), "end_page")


def attach_notes(notes: DataFrame, chapters: DataFrame) -> DataFrame:
    """notes with ch: the chapter whose page range (up to end_page, open on the last) holds the note's page."""
    ranges = chapters.select(F.col("book_id").alias("b"), "ch", F.col("start_page").alias("from"), F.col("end_page").alias("to"))
    within = (F.col("book_id") == F.col("b")) & (F.col("page_no") >= F.col("from")) & (F.col("to").isNull() | (F.col("page_no") < F.col("to")))
    return notes.join(ranges, within).drop("b", "from", "to")


def drop_print_nav(chapters: DataFrame) -> DataFrame:
    """Chapters without printed contents lists, with new_ch: their numbers without gaps. A book that has no other chapter keeps them."""
    nav = _like(strip(F.col("title")), P.PRINT_NAV)
    some = F.max((~nav).cast("int")).over(Window.partitionBy("book_id"))
    return chapters.withColumn("_some", some).where(~nav | (F.col("_some") == 0)).drop("_some").withColumn("new_ch", (F.row_number().over(Window.partitionBy("book_id").orderBy("ch")) - 1).cast("long"))


def renumbered(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rows of the chapters that drop_print_nav left, under their new numbers."""
    return rows.join(chapters.select("book_id", "ch", "new_ch"), ["book_id", "ch"]).withColumn("ch", F.col("new_ch")).select(*rows.columns)


def drop_front_lists(elements: DataFrame) -> DataFrame:
    """Elements (with ch) without lists of illustrations and the like: from such a heading to the next one of its level or less.

    For each level the latest heading of that level or less decides: the element goes if that heading opens a list at
    just this level.
    """
    w = Window.partitionBy(*_CH).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    opens = _like(strip(runs_text()), P.FRONT_LIST)
    gone = F.lit(False)
    for level in (1, 2, 3, 4):
        gone = gone | F.coalesce(F.last(F.when(heading & (F.col("level") <= level), opens & (F.col("level") == level)), ignorenulls=True).over(w), F.lit(False))
    return elements.withColumn("_gone", gone).where(~F.col("_gone")).drop("_gone")


def endnotes(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements without the chapter's first Notes section, and its notes (book_id, ch, page_no, ord, note_id en{ch}-{label}, label, text).

    The section is the heading and the paragraphs after it up to the first other element; its first paragraph must
    carry a label. Paragraphs without one continue the note before.
    """
    ch = Window.partitionBy(*_CH)
    w = ch.orderBy(*_ORDER)
    rows = elements.withColumn("text", runs_text()).withColumn("i", F.row_number().over(w))
    head = (F.col("kind") == "heading") & _like(strip(F.col("text")), P.NOTES_HEAD)
    rows = rows.withColumn("start", F.min(F.when(head, F.col("i"))).over(ch))
    rows = rows.withColumn("stop", F.min(F.when((F.col("i") > F.col("start")) & (F.col("kind") != "paragraph"), F.col("i"))).over(ch))
    inside = (F.col("i") > F.col("start")) & (F.col("stop").isNull() | (F.col("i") < F.col("stop")))
    label = F.when(inside & _like(F.col("text"), P.NOTE_ENTRY), F.regexp_extract("text", P.NOTE_ENTRY, 1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False))).withColumn("label", label)
    rows = rows.withColumn("works", F.coalesce(F.max(F.when((F.col("i") == F.col("start") + 1) & F.col("label").isNotNull(), 1)).over(ch), F.lit(0)))
    body = rows.where((F.col("works") == 0) | F.coalesce(~F.col("inside") & (F.col("i") != F.col("start")), F.lit(True)))
    noted = rows.where((F.col("works") == 1) & F.col("inside")).withColumn("k", F.count("label").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("label").isNotNull(), strip(F.regexp_extract("text", P.NOTE_ENTRY, 2))).otherwise(strip(F.col("text")))
    made = noted.withColumn("part", part).groupBy(*_CH, "k").agg(F.min("page_no").alias("page_no"), F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("i", "part"))).alias("ps"))
    text = dehyphenated(F.transform("ps", lambda p: p["part"]))
    notes = made.select(*_CH, "page_no", F.col("k").cast("int").alias("ord"), F.concat(F.lit("en"), F.col("ch").cast("string"), F.lit("-"), F.col("label")).alias("note_id"), "label", text.alias("text"))
    return body.select(*elements.columns), notes


def style_references(elements: DataFrame) -> DataFrame:
    """Paragraphs after a References heading, up to the next heading, become references."""
    w = Window.partitionBy(*_CH).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    refs = F.last(F.when(F.col("kind") == "heading", _like(strip(runs_text()), P.REFERENCES_HEAD)), ignorenulls=True).over(w)
    return elements.withColumn("kind", F.when((F.col("kind") == "paragraph") & F.coalesce(refs, F.lit(False)), "reference").otherwise(F.col("kind")))


def subheads(elements: DataFrame) -> DataFrame:
    """book_id, ch, page_no, cls, ord, k, anchor sec-{ch}-{k}, title, level, number of each heading below its chapter's top level."""
    heads = elements.where("kind = 'heading'").withColumn("title", strip(runs_text()))
    heads = heads.withColumn("top", F.min("level").over(Window.partitionBy(*_CH))).where("level > top")
    k = F.row_number().over(Window.partitionBy(*_CH).orderBy(*_ORDER)) - 1
    number = r"(?U)^\s*(\d+(?:\.\d+){0,3})\.?\s+"
    return heads.withColumn("k", k).select(*_CH, *_ORDER, "k", F.concat_ws("-", F.lit("sec"), F.col("ch").cast("string"), F.col("k").cast("string")).alias("anchor"), "title", "level", F.when(_like(F.col("title"), number), F.regexp_extract("title", number, 1)).alias("number"))


SECTION = r"(?iU)\b((?:section|sec\.)\s+(\d+(?:\.\d+){0,3}))\b"


def linked_runs(runs: str, targets: str) -> Column:
    """Runs with `section N` as a link where targets (a map from number to anchor) has N; parts keep the run's style."""
    mark = lambda r: F.regexp_replace(r["text"], SECTION, "\u0001$1\u0002")

    def parts(r):
        pieces = F.regexp_extract_all(mark(r), F.lit(r"(?s)(\u0001[^\u0002]*\u0002|[^\u0001]+)"), F.lit(1))
        bare = lambda p: F.translate(p, "\u0001\u0002", "")
        target = lambda p: F.when(F.startswith(p, F.lit("\u0001")), F.element_at(targets, F.regexp_extract(bare(p), r"([\d.]+)$", 1)))
        return F.transform(pieces, lambda p: F.struct(bare(p).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), r["sup"].alias("sup"), F.lit(None).cast("string").alias("noteref"), F.when(target(p).isNotNull(), F.concat(F.lit("#"), target(p))).alias("href")))

    linked = F.transform(runs, lambda r: F.when(r["href"].isNull() & r["noteref"].isNull() & _like(r["text"], SECTION), parts(r)).otherwise(F.array(r)))
    # neighbours that the split made and no link parts join again
    joined = lambda acc, x: F.when(
        (F.size(acc) > 0) & x["href"].isNull() & x["noteref"].isNull() & F.get(acc, F.size(acc) - 1)["href"].isNull() & F.get(acc, F.size(acc) - 1)["noteref"].isNull(),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.get(acc, F.size(acc) - 1).withField("text", F.concat(F.get(acc, F.size(acc) - 1)["text"], x["text"])))),
    ).otherwise(F.concat(acc, F.array(x)))
    rejoined = F.transform(linked, lambda rs: F.when(F.size(rs) > 1, F.aggregate(rs, F.slice(rs, 1, 0), joined)).otherwise(rs))
    return F.flatten(rejoined).cast(f"array<{S.RUN}>")


def assign_nav(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with anchors on sub-headings and section references linked within the chapter, and the sub-headings."""
    subs = subheads(elements)
    last = subs.where("number is not null").groupBy(*_CH, "number").agg(F.max_by("anchor", "k").alias("anchor"))
    targets = last.groupBy(*_CH).agg(F.map_from_entries(F.collect_list(F.struct("number", "anchor"))).alias("targets"))
    rows = elements.join(subs.select(*_CH, *_ORDER, F.col("anchor").alias("_a")), [*_CH, *_ORDER], "left").join(targets, list(_CH), "left")
    can = F.col("kind").isin("paragraph", "blockquote", "caption") & F.col("targets").isNotNull()
    rows = rows.withColumn("runs", F.when(can, linked_runs("runs", "targets")).otherwise(F.col("runs"))).withColumn("anchor", F.coalesce("_a", "anchor"))
    return rows.select(*elements.columns), subs


def bind_notes(elements: DataFrame, notes: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Elements with every marker bound to a note of its chapter, or else a plain superscript.

    own: the chapter's endnotes, to which markers go whose id is no other note's; then ids, then labels that only one note has.
    """
    ids = notes.where("note_id is not null").groupBy(*_CH).agg(F.collect_set("note_id").alias("ids"))
    every = notes if own is None else notes.unionByName(own.select(*notes.columns))
    labels = every.where("trim(label) <> ''").groupBy(*_CH, F.trim("label").alias("l")).agg(F.min("note_id").alias("id"), F.count("*").alias("n"))
    unique = labels.where("n = 1").groupBy(*_CH).agg(F.map_from_entries(F.collect_list(F.struct("l", "id"))).alias("unique"))
    rows = elements.join(ids, list(_CH), "left").join(unique, list(_CH), "left")
    if own is not None:
        ends = own.groupBy(*_CH, "label").agg(F.min("note_id").alias("id")).groupBy(*_CH).agg(F.map_from_entries(F.collect_list(F.struct("label", "id"))).alias("ends"))
        rows = rows.join(ends, list(_CH), "left")
    else:
        rows = rows.withColumn("ends", F.lit(None).cast("map<string,string>"))
    label = lambda r: strip(r["text"])
    end = lambda r: F.when(F.col("ends").isNotNull(), F.element_at("ends", label(r)))
    only = lambda r: F.when(F.col("unique").isNotNull(), F.element_at("unique", label(r)))
    known = lambda r: F.coalesce(F.array_contains("ids", r["noteref"]), F.lit(False))
    target = lambda r: F.when(known(r), r["noteref"]).otherwise(F.coalesce(end(r), only(r)))
    bound = F.transform("runs", lambda r: F.when(r["noteref"].isNull(), r).when(target(r).isNull(), r.withField("noteref", F.lit(None).cast("string")).withField("sup", F.lit(True))).otherwise(r.withField("noteref", target(r))))
    return rows.withColumn("runs", bound).select(*elements.columns)


def guess_title(elements: DataFrame) -> DataFrame:
    """book_id, title: the largest heading of the first two chapters, with the next one as subtitle if it is smaller in a certain measure."""
    heads = elements.where("ch < 2 and kind = 'heading'").withColumn("text", strip(runs_text())).where("text <> ''")
    w = Window.partitionBy("book_id").orderBy("ch", *_ORDER)
    heads = heads.select("book_id", "ch", *_ORDER, "text", "size", F.lead("text").over(w).alias("next"), F.lead("size").over(w).alias("next_size"))
    # the largest; without any size the first: both by (size descending, place)
    best = heads.groupBy("book_id").agg(F.min_by(F.struct("text", "size", "next", "next_size"), F.struct(-F.greatest("size", F.lit(0.0)), "ch", *_ORDER)).alias("h"))
    ratio = F.col("h.next_size") / F.col("h.size")
    sub = (F.col("h.size") > 0) & ratio.between(0.4, 0.75) & (n_words(F.col("h.next")) <= 10)
    title = F.when(F.coalesce(sub, F.lit(False)), F.substring(F.concat(F.col("h.text"), F.lit(": "), F.col("h.next")), 1, 160)).otherwise(F.substring("h.text", 1, 120))
    books = elements.select("book_id").distinct()
    return books.join(best.select("book_id", title.alias("title")), "book_id", "left").withColumn("title", F.coalesce("title", F.lit("Untitled")))


def guess_author(elements: DataFrame) -> DataFrame:
    """book_id, author: the name in the first copyright line among the first 60 elements of the first two chapters; empty without one."""
    rows = elements.where("ch < 2").withColumn("k", F.row_number().over(Window.partitionBy(*_CH).orderBy(*_ORDER))).where("k <= 60")
    name = strip(F.regexp_extract(runs_text(), P.COPYRIGHT_NAME, 1))
    found = rows.withColumn("name", name).groupBy("book_id").agg(F.min_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.struct("ch", "k"))).alias("author"))
    return found.select("book_id", F.coalesce("author", F.lit("")).alias("author"))
