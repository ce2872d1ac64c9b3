"""Raw lines to clean lines: garbled and empty ones out, fragments of one row together, map and scanned pages found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.spans import with_text
from quire.functions.text import is_garbled, is_other_script, n_words, strip

SAME_ROW = 1.5
COLUMN_GAP = 5.0
_PAGE = ("book_id", "page_no")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines without empty spans, sizes in tenths; lines with no span left or garbled text go."""
    spans = F.transform(F.filter("spans", lambda s: F.length(s["text"]) > 0), lambda s: s.withField("size", F.bround(s["size"], 1)))
    kept = with_text(lines.withColumn("spans", spans).where(F.size("spans") > 0))
    return kept.where(~is_garbled(F.col("text")))


def merge_rows(lines: DataFrame, block: str = "block_no") -> DataFrame:
    """Consecutive lines of a block whose tops lie within 1.5 points of the first one's become one line, fragments from left to right.

    A fragment that neither ends nor is followed by white space gets one. Folded over one block's lines.
    """
    item = F.struct("line_no", "x0", "y0", "x1", "y1", "spans")
    blocks = lines.groupBy(*_PAGE, block, "width", "height").agg(F.array_sort(F.collect_list(item)).alias("ls"))
    kind = blocks.schema["ls"].dataType.simpleString()
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.abs(x["y0"] - F.get(F.element_at(acc, -1), F.lit(0))["y0"]) <= SAME_ROW), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(x))))).otherwise(F.concat(acc, F.array(F.array(x))))
    # element_at of an empty array is an error, so the fold starts with an empty group that is dropped
    start = F.array(F.array().cast(kind))
    groups = F.filter(F.aggregate("ls", start, step), lambda g: F.size(g) > 0)
    rows = blocks.select(*_PAGE, block, "width", "height", F.explode(groups).alias("g"))
    by_x = F.transform(F.array_sort(F.transform("g", lambda l, i: F.struct(l["x0"].alias("x"), i.alias("i"), l["spans"].alias("spans")))), lambda l: l["spans"])  # noqa: E741
    glue = lambda a, b: F.when(F.size(a) == 0, b).when(
        F.regexp_like(F.element_at(a, -1)["text"], F.lit(r"[ \t]$")) | F.regexp_like(F.get(b, F.lit(0))["text"], F.lit(r"^[ \t]")), F.concat(a, b)
    ).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.element_at(a, -1).withField("text", F.concat(F.element_at(a, -1)["text"], F.lit(" ")))), b))
    empty = F.slice(F.get("g", F.lit(0))["spans"], 1, 0)
    merged = rows.select(
        *_PAGE, block, F.get("g", F.lit(0))["line_no"].alias("line_no"),
        F.when(F.size("g") == 1, F.get("g", F.lit(0))["spans"]).otherwise(F.aggregate(by_x, empty, glue)).alias("spans"),
        F.array_min("g.x0").alias("x0"), F.array_min("g.y0").alias("y0"), F.array_max("g.x1").alias("x1"), F.array_max("g.y1").alias("y1"),
        "width", "height",
    )
    return merged


def column_count(lines: DataFrame) -> DataFrame:
    """book_id, page_no, columns: left edges in clusters that end where the next edge is more than five points on."""
    gap = F.col("x0") - F.lag("x0").over(Window.partitionBy(*_PAGE).orderBy("x0"))
    return lines.select(*_PAGE, F.when(gap.isNull() | (gap > COLUMN_GAP), 1).otherwise(0).alias("new")).groupBy(*_PAGE).agg(F.sum("new").alias("columns"))


def page_shape(lines: DataFrame) -> DataFrame:
    """book_id, page_no, n, avg_words, upper_median_chars, columns of the lines given."""
    lengths = F.sort_array(F.collect_list(F.length(strip(F.col("text")))))
    shape = lines.groupBy(*_PAGE).agg(F.count("*").alias("n"), (F.sum(n_words(F.col("text"))) / F.count("*")).alias("avg_words"), lengths.alias("ls"))
    shape = shape.withColumn("upper_median_chars", F.get("ls", (F.col("n") / 2).cast("int"))).drop("ls")
    return shape.join(column_count(lines), list(_PAGE))


def map_pages(lines: DataFrame) -> DataFrame:
    """Pages that are maps: ten lines or more, short ones, at more than ten left edges. Such pages become one raster, without lines."""
    shape = page_shape(lines.where(strip(F.col("text")) != ""))
    return shape.where("n >= 10 and avg_words < 2.5 and upper_median_chars < 25 and columns > 10").select(*_PAGE)


def char_counts(lines: DataFrame) -> DataFrame:
    """book_id, page_no, chars: characters of trimmed spans."""
    n = F.aggregate(F.transform("spans", lambda s: F.length(strip(s["text"]))), F.lit(0), lambda a, b: a + b)
    return lines.groupBy(*_PAGE).agg(F.sum(n).alias("chars"))


def image_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, page_no, coverage: the largest image's share of the page; 0 without images or page size."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    top = images.groupBy(*_PAGE).agg(F.max(area).alias("area"))
    full = F.col("width") * F.col("height")
    return pages.join(top, list(_PAGE), "left").select(*_PAGE, F.when((F.col("width") > 0) & (F.col("height") > 0), F.coalesce("area", F.lit(0.0)) / full).otherwise(0.0).alias("coverage"))


def scan_plan(pages: DataFrame, lines: DataFrame, images: DataFrame, mode: str = "auto", ocr: bool = True, repair: bool = False) -> DataFrame:
    """book_id, page_no, action: ocr (no text under an image, or forced), repair (text over a scan) or keep."""
    joined = image_coverage(images, pages).join(char_counts(lines), list(_PAGE), "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    want = F.lit(ocr and mode == "force") | (F.lit(ocr and mode == "auto") & (F.col("chars") < 12) & (F.col("coverage") > 0.5))
    action = F.when(want, "ocr").when(F.lit(repair) & (F.col("coverage") > 0.85), "repair").otherwise("keep")
    return joined.select(*_PAGE, "chars", "coverage", action.alias("action"))


def with_ocr(lines: DataFrame, plan: DataFrame, read: DataFrame) -> DataFrame:
    """Lines with those of OCR pages replaced, where OCR read 25 characters or more."""
    good = char_counts(with_text(read)).where("chars >= 25").join(plan.where("action = 'ocr'"), list(_PAGE), "left_semi").select(*_PAGE)
    return lines.join(good, list(_PAGE), "left_anti").unionByName(with_text(read).join(good, list(_PAGE), "left_semi"), allowMissingColumns=True)


def kept_images(images: DataFrame, pages: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """Images without those that cover four fifths of a page that OCR replaced."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    sized = images.join(pages.select(*_PAGE, "width", "height"), list(_PAGE)).join(ocr_pages.select(*_PAGE).withColumn("_ocr", F.lit(True)), list(_PAGE), "left")
    return sized.where(F.col("_ocr").isNull() | (area < 0.8 * F.col("width") * F.col("height"))).drop("_ocr", "width", "height")


def suspicious_pages(scored: DataFrame, limit: float = 0.95) -> DataFrame:
    """Pages with a line of Latin script whose share of known words is below the limit. scored: lines with text and score."""
    low = (F.col("score") < limit) & ~is_other_script(F.col("text"))
    return scored.groupBy(*_PAGE).agg(F.bool_or(F.coalesce(low, F.lit(False))).alias("low")).where("low").select(*_PAGE)
