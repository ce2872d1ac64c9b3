"""Statistics of a book: weighted modes, medians, and texts that recur in the margins.

All are aggregations by (book, value), so that a book's rows are summed before they move and one large book does not
meet in one task; the winner among the few values of a book is then taken with an ordinal tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import running_key, strip

DEFAULT_SIZE, DEFAULT_HEIGHT, DEFAULT_LEFT = 11.0, 12.0, 0.0
_ORD = ("page_no", "line_no")


def _mode(rows: DataFrame, value: str, weight, order: list, name: str, default: float) -> DataFrame:
    """The value with the largest weight in each book; the first met wins a tie."""
    sums = rows.groupBy("book_id", value).agg(F.sum(weight).alias("w"), F.min(F.struct(*order)).alias("first"))
    best = sums.groupBy("book_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "first", F.col(value).alias("v"))).alias("m"))
    return best.select("book_id", F.coalesce("m.v", F.lit(default)).alias(name))


def body_size(lines: DataFrame) -> DataFrame:
    """book_id, body_size: the size most characters are set in."""
    spans = lines.select("book_id", *_ORD, F.posexplode("spans").alias("span_no", "s")).select("book_id", *_ORD, "span_no", F.col("s.size").alias("size"), F.length(strip(F.col("s.text"))).alias("n"))
    return _mode(spans, "size", "n", [*_ORD, "span_no"], "body_size", DEFAULT_SIZE)


def line_height(lines: DataFrame) -> DataFrame:
    """book_id, line_height: the exact median of positive line heights."""
    h = F.col("y1") - F.col("y0")
    return lines.groupBy("book_id").agg(F.coalesce(F.median(F.when(h > 0, h)), F.lit(DEFAULT_HEIGHT)).alias("line_height"))


def body_left(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """book_id, body_left: the most frequent left edge (rounded half to even) of filled lines of about the body size."""
    rows = lines.join(sizes, "book_id").where((F.abs(F.col("size") - F.col("body_size")) <= 0.6) & (strip(F.col("text")) != ""))
    return _mode(rows.withColumn("x", F.bround("x0")), "x", F.lit(1), list(_ORD), "body_left", DEFAULT_LEFT)


def book_stats(lines: DataFrame) -> DataFrame:
    """book_id, body_size, line_height, body_left: one row for each book."""
    sizes = body_size(lines)
    left = body_left(lines, sizes)
    out = line_height(lines).join(sizes, "book_id", "left").join(left, "book_id", "left")
    return out.select("book_id", F.coalesce("body_size", F.lit(DEFAULT_SIZE)).alias("body_size"), "line_height", F.coalesce("body_left", F.lit(DEFAULT_LEFT)).alias("body_left"))


def common_sizes(lines: DataFrame, k: int = 6) -> DataFrame:
    """book_id, sizes: the k most frequent span sizes (tenths), most frequent first; the first met wins a tie."""
    spans = lines.select("book_id", *_ORD, F.posexplode("spans").alias("span_no", "s")).select("book_id", *_ORD, "span_no", F.bround("s.size", 1).alias("size"))
    sums = spans.groupBy("book_id", "size").agg(F.count("*").alias("n"), F.min(F.struct(*_ORD, "span_no")).alias("first"))
    top = sums.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "size"))).alias("all"))
    return top.select("book_id", F.transform(F.slice("all", 1, k), lambda x: x["size"]).alias("sizes"))


def in_band():
    return (F.col("y1") <= F.col("height") * P.TOP_BAND) | (F.col("y0") >= F.col("height") * P.BOTTOM_BAND)


def margin_repeats(lines: DataFrame) -> DataFrame:
    """book_id, running, repeats: how often a text, its digits aside, stands in the top or bottom band."""
    rows = lines.where((F.col("height") > 0) & (strip(F.col("text")) != "") & in_band())
    return rows.groupBy("book_id", running_key(F.col("text")).alias("running")).agg(F.count("*").alias("repeats"))
