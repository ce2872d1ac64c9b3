"""Page roles: weighted evidence by page, and the role with the largest score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import n_words, strip
from quire.operators.scan import page_shape

_PAGE = ("book_id", "page_no")
#: Evidence: signal and weight.
WEIGHTS = {
    "first-page-cover": 0.45, "contents-keyword": 0.85, "contents-shape": 0.65, "copyright-keyword": 0.75, "index-heading": 0.95,
    "large-heading": 0.55, "many-short-lines": 0.25, "bibliography-heading": 0.95, "large-figure": 0.5, "image-only": 0.7,
}
#: Roles in order of precedence among equal scores, with the signals that count for them.
CANDIDATES = {
    "cover": ("first-page-cover",), "contents": ("contents-keyword", "contents-shape"), "copyright": ("copyright-keyword",), "index": ("index-heading",),
    "bibliography": ("bibliography-heading",), "chapter_opening": ("large-heading",), "table_figure": ("large-figure",),
}
LEAST, MOST, SHORT_BONUS = 0.55, 0.99, 0.15


def page_text(lines: DataFrame) -> DataFrame:
    """book_id, page_no, txt: the trimmed filled lines of each page, joined by spaces."""
    t = strip(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.when(t != "", F.struct("line_no", t.alias("t")))))
    return lines.groupBy(*_PAGE).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("txt"))


def classify_pages(lines: DataFrame, stats: DataFrame, images: DataFrame | None = None, words=n_words) -> DataFrame:
    """book_id, page_no, page_type, confidence, evidence (array of signal and weight), in the order of WEIGHTS. words: counts a line's words."""
    t = strip(F.col("text"))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    rows = lines.join(stats.select("book_id", "body_size"), "book_id").withColumn("t", t)
    top = F.slice(F.array_sort(F.collect_list(F.struct("line_no", "t"))), 1, 8)
    page = rows.groupBy(*_PAGE).agg(
        F.count("*").alias("n"), top.alias("top"), F.sum(like(F.col("text"), P.DOT_LEADER).cast("int")).alias("leaders"),
        F.bool_or(F.col("size") > F.col("body_size") * 1.35).alias("large"), F.sum((words(F.col("text")) <= 4).cast("int")).alias("short"), F.max("width").alias("width"), F.max("height").alias("height"),
    ).join(page_text(lines), list(_PAGE))
    if images is None:
        page = page.withColumn("n_images", F.lit(0)).withColumn("big", F.lit(False))
    else:
        sized = images.join(page.select(*_PAGE, "width", "height"), list(_PAGE))
        pics = sized.groupBy(*_PAGE).agg(F.count("*").alias("n_images"), F.bool_or((F.col("px_width") > F.col("width") * 0.55) & (F.col("px_height") > F.col("height") * 0.25)).alias("big"))
        page = page.join(pics, list(_PAGE), "left").na.fill({"n_images": 0, "big": False})
    n_word = F.regexp_count("txt", F.lit(r"[\p{L}\p{N}_]+"))
    heading = F.exists("top", lambda x: like(x["t"], P.TOC_HEADING))
    when = {
        "first-page-cover": (F.col("page_no") == 0) & ((F.col("n_images") > 0) | (n_word < 120)),
        "contents-keyword": heading,
        "contents-shape": ~heading & (F.col("leaders") >= 2) & (F.col("n") >= 8),
        "copyright-keyword": (F.col("page_no") < 6) & like(F.col("txt"), P.COPYRIGHT_WORD),
        "index-heading": like(F.col("txt"), P.INDEX_PAGE),
        "large-heading": F.col("large"),
        "many-short-lines": (F.col("n") >= 10) & (F.col("short") / F.greatest(F.col("n"), F.lit(1)) > 0.45),
        "bibliography-heading": F.exists("top", lambda x: like(x["t"], P.BIBLIOGRAPHY_HEAD)),
        "large-figure": F.col("big"),
        "image-only": (n_word == 0) & (F.col("n_images") > 0),
    }
    evidence = F.array_compact(F.array(*[F.when(when[s], F.struct(F.lit(s).alias("signal"), F.lit(w).alias("weight"))) for s, w in WEIGHTS.items()]))
    page = page.withColumn("evidence", evidence)
    has = lambda s: F.exists("evidence", lambda e: e["signal"] == s)
    scores = []
    for i, (role, signals) in enumerate(CANDIDATES.items()):
        score = sum((F.when(has(s), WEIGHTS[s]).otherwise(0.0) for s in signals), F.lit(0.0))
        if role == "contents":
            score = score + F.when(has("many-short-lines"), SHORT_BONUS).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("first"), F.lit(role).alias("role")))
    best = F.array_max(F.array(*scores))
    page = page.withColumn("best", best)
    sure = F.col("best.score") >= LEAST
    return page.select(*_PAGE, F.when(sure, F.col("best.role")).otherwise("prose").alias("page_type"), F.when(sure, F.least(F.col("best.score"), F.lit(MOST))).otherwise(LEAST).alias("confidence"), "evidence")


def role_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("book_id", "page_type").agg(F.count("*").alias("pages"))


def headless_contents(lines: DataFrame) -> DataFrame:
    """Pages among a book's first 25 that have a contents list's shape and words though its heading is gone. lines: body lines."""
    early = lines.where(F.col("page_no") < P.TOC_PAGE_LIMIT)
    shape = page_shape(early).where("n >= 10 and avg_words < 3.5 and upper_median_chars < 30 and columns between 2 and 12")
    joined = early.groupBy(*_PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("txt"))
    return joined.join(shape, list(_PAGE)).where(F.regexp_like("txt", F.lit(P.TOC_KEYWORDS))).select(*_PAGE)
