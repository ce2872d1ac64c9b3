"""Running values over a book in two steps: sums by page first, then over pages, so that no task sorts a whole book's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of elements: text (cls 0) before images (1) on a page.
ORDER = ("cls", "ord")
_PAGE = ("book_id", "page_no")


def running_sum(rows: DataFrame, value: Column, name: str, order=ORDER) -> DataFrame:
    """rows with name: the sum of value up to each row of its book, in order of page_no and order."""
    marked = rows.withColumn("_v", value)
    page = marked.groupBy(*_PAGE).agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("book_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    page = page.select(*_PAGE, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_v").over(Window.partitionBy(*_PAGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(page, list(_PAGE)).withColumn(name, F.col("_before") + within).drop("_v", "_before")


def previous(rows: DataFrame, names: list[str], prefix: str = "p_", order=ORDER) -> DataFrame:
    """rows with the named columns of the row before in the book, also over page borders; null on the first."""
    item = F.struct(*[F.col(n).alias(n) for n in names])
    page = rows.groupBy(*_PAGE).agg(F.max_by(item, F.struct(*order)).alias("_last"))
    page = page.select(*_PAGE, F.lag("_last").over(Window.partitionBy("book_id").orderBy("page_no")).alias("_last"))
    w = Window.partitionBy(*_PAGE).orderBy(*order)
    out = rows.join(page, list(_PAGE)).withColumn("_here", F.lag(item).over(w)).withColumn("_p", F.coalesce("_here", "_last"))
    return out.select(*rows.columns, *[F.col("_p")[n].alias(prefix + n) for n in names])
