"""A page's lines in reading order, without furniture, parted into body and notes.

Page rules are windows over one page. Book rules (where a Notes section opens and closes) are carried over one row for
each page, not over all lines of a book, so that the rows of one book that meet in a task stay few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.spans import filled, is_superscript
from quire.functions.text import is_debris, n_words, running_key, strip
from quire.operators.stats import margin_repeats

_PAGE = ("book_id", "page_no")


def _page(*order):
    return Window.partitionBy(*_PAGE).orderBy(*order)


def furniture_rule(at_top: bool, gap):
    """Is a line of the margin furniture? The first rule that applies decides. gap: distance to the neighbouring line, null without one."""
    t = strip(F.col("text"))
    band = F.col("y1") <= F.col("height") * P.TOP_BAND if at_top else F.col("y0") >= F.col("height") * P.BOTTOM_BAND
    folio = F.regexp_like(t, F.lit(P.FOLIO)) & (F.length(t) <= 12) & (F.col("size") / F.col("body_size") < 1.8)
    rule = F.when(t == "", True).when(~band, False).when(folio, True).when(F.col("size") > F.col("body_size") + 0.3, False)
    if at_top:
        rule = rule.when(F.col("size") <= F.col("body_size") - 1.5, True)
    alone = (n_words(t) <= 10) & (gap >= F.col("line_height") * 1.4)
    return rule.when(F.coalesce("repeats", F.lit(0)) >= P.MIN_REPEATS, True).when(F.coalesce(alone, F.lit(False)), True).otherwise(False)


def furniture(lines: DataFrame, stats: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """lines (with the book's statistics) and is_furniture: up to three lines peeled from the top and then from the bottom; one line always stays."""
    repeats = margin_repeats(lines) if repeats is None else repeats
    rows = lines.join(stats, "book_id").withColumn("running", running_key(F.col("text"))).join(repeats, ["book_id", "running"], "left")
    down = _page("y0", "line_no")
    top = furniture_rule(True, F.lead("y0").over(down) - F.col("y1"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*_PAGE))).withColumn("i", F.row_number().over(down)).withColumn("top", top.cast("int"))
    prefix = F.min("top").over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("gone", (prefix == 1) & (F.col("i") <= P.MAX_PEELED) & (F.col("i") <= F.col("n") - 1))
    rows = rows.withColumn("n", F.col("n") - F.sum(F.col("gone").cast("int")).over(Window.partitionBy(*_PAGE)))
    # the rest from the bottom: the neighbour is the kept line before, if it was not peeled
    last = F.lag("y1").over(down)
    kept_before = F.lag("gone").over(down)
    bottom = furniture_rule(False, F.when(~kept_before, F.col("y0") - last))
    up = _page(F.desc("y0"), F.desc("line_no"))
    rows = rows.withColumn("bottom", F.when(F.col("gone"), 0).otherwise(bottom.cast("int"))).withColumn("j", F.row_number().over(up))
    suffix = F.min("bottom").over(up.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("is_furniture", F.col("gone") | ((suffix == 1) & (F.col("j") <= P.MAX_PEELED) & (F.col("j") <= F.col("n") - 1)))
    return rows.drop("n", "i", "j", "top", "bottom", "gone", "running", "repeats")


def strip_furniture(lines: DataFrame, stats: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """Lines (with the book's statistics) without blank ones, stray marks and page furniture. Repeats are counted on all lines."""
    repeats = margin_repeats(lines) if repeats is None else repeats
    kept = lines.where((strip(F.col("text")) != "") & ~is_debris(F.col("text")))
    return furniture(kept, stats, repeats).where(~F.col("is_furniture")).drop("is_furniture")


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with col (0 left or single, 1 right) and pos (from 1).

    A page of six lines or more is in two columns if the left and the right half have four lines or more each, at most
    15 % cross the middle, and the left half has 40 to 60 % of the rest. A line within the gutter counts as left.
    """
    page = Window.partitionBy(*_PAGE)
    mid, slack = F.col("width") / 2, F.col("width") * 0.03
    left, right = F.col("x1") <= mid + slack, F.col("x0") >= mid - slack
    rows = lines.withColumn("l", left.cast("int")).withColumn("r", (right & ~left).cast("int"))
    rows = rows.withColumn("n", F.count("*").over(page)).withColumn("nl", F.sum("l").over(page)).withColumn("nr", F.sum("r").over(page))
    both = F.col("nl") + F.col("nr")
    two = (F.col("n") >= 6) & (F.col("nl") >= 4) & (F.col("nr") >= 4) & (F.col("n") - both <= F.col("n") * 0.15) & (F.col("nl") / F.greatest(both, F.lit(1))).between(0.4, 0.6)
    rows = rows.withColumn("col", F.when(two & (F.col("r") == 1), 1).otherwise(0))
    order = _page("col", F.bround("y0", 1), "x0", "line_no")
    return rows.withColumn("pos", F.row_number().over(order)).drop("l", "r", "n", "nl", "nr")


def opens_note():
    """Does the line begin as a note does: by its text, or by a raised or small digit span?"""
    first = F.get(F.filter("spans", filled), F.lit(0))
    small = (is_superscript(first) | (first["size"] <= F.col("body_size") - 1.0)) & F.regexp_like(first["text"], F.lit(r"(?U)^\s*\d"))
    return F.regexp_like("text", F.lit(P.NOTE_START)) | F.coalesce(small, F.lit(False))


def note_zone(lines: DataFrame) -> DataFrame:
    """lines (with statistics and pos) and zone: body or note.

    Notes are the lines from the first note opener within the run of small lines at the page's foot (top below 35 % of
    its height), unless fewer than two lines of body size would remain.
    """
    up = _page(F.desc("y0"), F.desc("pos"))
    small = ((F.col("size") <= F.col("body_size") - 0.3) & (F.col("y0") >= F.col("height") * 0.35)).cast("int")
    rows = lines.withColumn("small", small).withColumn("run", F.min("small").over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    down = _page("y0", "pos")
    rows = rows.withColumn("k", F.row_number().over(down)).withColumn("first", F.min(F.when(F.col("run") & opens_note(), F.col("k"))).over(Window.partitionBy(*_PAGE)))
    rows = rows.withColumn("note", F.col("run") & F.coalesce(F.col("k") >= F.col("first"), F.lit(False)))
    body = F.sum(F.when(~F.col("note") & (F.col("size") >= F.col("body_size") - 0.3), 1).otherwise(0)).over(Window.partitionBy(*_PAGE))
    return rows.withColumn("zone", F.when(F.col("note") & (body >= 2), "note").otherwise("body")).drop("small", "run", "k", "first", "note")


def endnote_sections(lines: DataFrame) -> DataFrame:
    """Lines (with zone) with those of Notes sections moved to the note zone, and the headings that open them left out.

    A section opens at a Notes line of body size or more and runs to the next page's first line larger than the body by
    half a point; on the page where it opens everything after it is notes. Each page is a function from open or shut to
    open or shut, known from its own lines; these functions are composed over the pages of a book.
    """
    down = _page("pos")
    body = F.col("zone") == "body"
    head = body & F.regexp_like("text", F.lit(P.ENDNOTE_HEAD)) & (F.col("size") >= F.col("body_size"))
    big = body & (F.col("size") > F.col("body_size") + 0.5)
    marked = lines.withColumn("head", F.when(head, F.col("pos"))).withColumn("big", F.when(big, F.col("pos")))
    page = marked.groupBy(*_PAGE).agg(F.min("big").alias("cut"), F.min("head").alias("head1"), F.max("head").alias("head_last"))
    shut = F.col("head1").isNotNull().cast("int")
    open_ = F.when(F.col("cut").isNull(), 1).otherwise((F.coalesce("head_last", F.lit(-1)) >= F.col("cut")).cast("int"))
    page = page.withColumn("f0", shut).withColumn("f1", open_).withColumn("flip", ((F.col("f0") == 1) & (F.col("f1") == 0)).cast("int"))
    book = Window.partitionBy("book_id").orderBy("page_no")
    before = book.rowsBetween(Window.unboundedPreceding, -1)
    page = page.withColumn("flips", F.sum("flip").over(book.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.col("f0") == F.col("f1")
    state = F.coalesce(F.last(F.when(fixed, F.col("f0")), ignorenulls=True).over(before), F.lit(0))
    since = F.coalesce(F.last("flips").over(before), F.lit(0)) - F.coalesce(F.last(F.when(fixed, F.col("flips")), ignorenulls=True).over(before), F.lit(0))
    page = page.select(*_PAGE, "cut", ((state + since) % 2 == 1).alias("open"))
    rows = marked.join(page, list(_PAGE))
    # on a page that begins open, notes run to the cut; after it (or from the start, where shut) a head opens them again
    early = F.col("open") & F.coalesce(F.col("pos") < F.col("cut"), F.lit(True))
    start = F.min(F.when(~early & F.col("head").isNotNull(), F.col("pos"))).over(Window.partitionBy(*_PAGE))
    rows = rows.withColumn("early", early).withColumn("start", start)
    moved = (F.col("zone") == "body") & (F.col("early") | F.coalesce(F.col("pos") > F.col("start"), F.lit(False)))
    rows = rows.where(~F.coalesce(F.col("pos") == F.col("start"), F.lit(False)))
    return rows.withColumn("zone", F.when(moved, "note").otherwise(F.col("zone"))).drop("head", "big", "cut", "open", "early", "start")


def analyze(lines: DataFrame, stats: DataFrame, order: str = "columns") -> DataFrame:
    """Cleaned, ordered and zoned lines. order: columns (left column, then right) or rows (all lines from top to bottom)."""
    rows = reading_order(strip_furniture(lines, stats))
    if order == "rows":
        rows = rows.withColumn("pos", F.row_number().over(_page("y0", "pos")))
    return endnote_sections(note_zone(rows))
