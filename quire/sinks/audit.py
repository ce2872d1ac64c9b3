"""Audit of rendered books: counts, dead links, leftover page furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import n_words, strip

CHAPTER_PART = r"^EPUB/chap_\d+\.xhtml$"
FOLIO = r"^(?U)[\divxlcIVXLC]{1,6}$"
YEAR = r"^(?U)(1[0-9]|20)\d{2}$"


def _all(text, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def chapter_counts(chapters: DataFrame) -> DataFrame:
    """book_id, name and what the audit counts in each chapter. chapters: book_id, name, html."""
    c = F.col("html")
    rows = chapters.select(
        "book_id", "name",
        F.array_distinct(_all(c, r'epub:type="noteref"[^>]*href="#([^"]+)"')).alias("refs"), F.array_distinct(_all(c, r'epub:type="footnote" id="([^"]+)"')).alias("note_ids"),
        F.regexp_count(c, F.lit(r"(?i)<table(?:\s|>)")).alias("tables"), F.regexp_count(c, F.lit(r"<sup>(?!<a)")).alias("unlinked"), F.regexp_count(c, F.lit(r'epub:type="pagebreak"')).alias("pagebreaks"),
        _all(c, r'<a[^>]+href="#([^"]+)"').alias("links"), F.array_distinct(_all(c, r'\bid="([^"]+)"')).alias("ids"), F.array_distinct(_all(c, r'<img[^>]*src="([^"]+)"')).alias("images"),
        _all(F.regexp_replace(c, r"(?s)<section.*$", ""), r"(?s)<p[^>]*>(.*?)</p>").alias("paras"), c.contains("style.css").alias("styled"),
    )
    texts = F.transform("paras", lambda p: strip(F.regexp_replace(p, r"<[^>]+>", "")))
    like = lambda t, p: F.regexp_like(t, F.lit(p))
    rows = rows.withColumn("texts", texts)
    return rows.select(
        "book_id", "name", "styled", "images", "tables", "unlinked", "pagebreaks", F.size("refs").alias("noterefs"), F.size("note_ids").alias("notes"), F.size("links").alias("internal_links"),
        F.transform(F.array_sort(F.array_except("refs", "note_ids")), lambda r: F.concat("name", F.lit("#"), r)).alias("dead_links"),
        F.transform(F.filter("links", lambda x: ~F.array_contains("ids", x) & ~F.array_contains("note_ids", x)), lambda r: F.concat("name", F.lit("#"), r)).alias("dead_internal_links"),
        F.aggregate("texts", F.lit(0), lambda a, t: a + n_words(t)).alias("words"),
        F.transform(F.filter("texts", lambda t: (t != "") & like(t, FOLIO) & ~like(t, YEAR)), lambda t: F.concat("name", F.lit(": "), t)).alias("furniture"),
    )


def audit(chapters: DataFrame, malformed: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """One row of counts and problem lists for each book, and ok.

    chapters: book_id, name, html. malformed: book_id, problem. parts: book_id, part (names in the package); without
    them images, style sheet and cover are taken to be there.
    """
    counts = chapter_counts(chapters)
    out = counts.groupBy("book_id").agg(
        F.count("*").alias("chapters"), *[F.sum(c).alias(c) for c in ("words", "tables", "pagebreaks", "internal_links", "notes", "noterefs")], F.sum("unlinked").alias("unlinked_markers"),
        *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("dead_links", "dead_internal_links", "furniture")], F.bool_and("styled").alias("stylesheet_linked"),
    )
    if parts is not None:
        names = parts.groupBy("book_id").agg(F.bool_or(F.lower("part").contains("cover")).alias("has_cover"), F.bool_or(F.endswith("part", F.lit("style.css"))).alias("_css"))
        used = counts.select("book_id", "name", F.explode("images").alias("src")).withColumn("part", F.concat(F.lit("EPUB/"), F.regexp_replace("src", r"^[./]+", "")))
        lost = used.join(parts.select("book_id", "part"), ["book_id", "part"], "left_anti").groupBy("book_id").agg(F.array_sort(F.collect_list(F.concat("name", F.lit(" -> "), F.col("src")))).alias("missing_images"))
        out = out.join(names, "book_id", "left").join(lost, "book_id", "left").withColumn("stylesheet_linked", F.col("stylesheet_linked") & F.col("_css")).drop("_css")
    else:
        out = out.withColumn("has_cover", F.lit(True)).withColumn("missing_images", F.array().cast("array<string>"))
    if malformed is not None:
        out = out.join(malformed.groupBy("book_id").agg(F.array_sort(F.collect_list("problem")).alias("malformed")), "book_id", "left")
    else:
        out = out.withColumn("malformed", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    out = out.withColumn("malformed", F.coalesce("malformed", empty)).withColumn("missing_images", F.coalesce("missing_images", empty)).withColumn("has_cover", F.coalesce("has_cover", F.lit(False)))
    fine = (F.size("dead_links") == 0) & (F.size("malformed") == 0) & (F.size("missing_images") == 0) & F.col("stylesheet_linked") & F.col("has_cover")
    return out.withColumn("ok", fine)


def as_json(audits: DataFrame) -> DataFrame:
    return audits.select("book_id", F.to_json(F.struct(*[c for c in audits.columns if c != "book_id"])).alias("json"))


def report(audits: DataFrame) -> DataFrame:
    """book_id, report: a few lines for a reader; of each kind of problem the first three."""
    line = lambda name, value: F.concat(F.lit(f"  {name:<10} "), value)
    number = lambda c: F.format_number(c, 0) if c == "words" else F.col(c).cast("string")
    notes = F.concat(F.col("notes").cast("string"), F.lit(" bodies / "), F.col("noterefs").cast("string"), F.lit(" linked markers"), F.when(F.col("unlinked_markers") > 0, F.concat(F.lit(", "), F.col("unlinked_markers").cast("string"), F.lit(" unlinked"))).otherwise(""))
    lines = [line("chapters", number("chapters")), line("words", number("words")), line("tables", number("tables")), line("pagebreaks", number("pagebreaks")), line("int. links", number("internal_links")), line("notes", notes)]
    lines += [line("stylesheet", F.when(F.col("stylesheet_linked"), "linked").otherwise("MISSING")), line("cover", F.when(F.col("has_cover"), "present").otherwise("MISSING"))]
    for c, label in (("dead_links", "dead note links"), ("malformed", "malformed XML"), ("missing_images", "missing images"), ("furniture", "page furniture left in text"), ("dead_internal_links", "dead internal links")):
        first = F.concat(F.array_join(F.slice(c, 1, 3), ", "), F.when(F.size(c) > 3, " ...").otherwise(""))
        lines.append(F.when(F.size(c) > 0, F.concat(F.lit("  ! "), F.size(c).cast("string"), F.lit(f" {label}: "), first)))
    lines.append(line("status", F.when(F.col("ok"), "OK").otherwise("ISSUES FOUND")))
    return audits.select("book_id", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("report"))


def epub_audit(parts: DataFrame) -> DataFrame:
    """The audit of EPUB parts (book_id, part, content): chapters are decoded, all XML is parsed on the executors."""
    import pandas as pd

    def run(frames):
        from xml.etree import ElementTree

        for frame in frames:
            for book, part, content in zip(frame.book_id, frame.part, frame.content, strict=True):
                try:
                    ElementTree.fromstring(bytes(content))
                except ElementTree.ParseError as e:
                    yield pd.DataFrame([(book, f"{part}: {e}")], columns=["book_id", "problem"])

    xml = parts.where(F.regexp_like("part", F.lit(r"\.(xhtml|opf|ncx|xml)$")))
    malformed = xml.mapInPandas(run, "book_id string, problem string")
    chapters = parts.where(F.regexp_like("part", F.lit(CHAPTER_PART))).select("book_id", F.col("part").alias("name"), F.col("content").cast("string").alias("html"))
    return audit(chapters, malformed, parts.select("book_id", "part"))
