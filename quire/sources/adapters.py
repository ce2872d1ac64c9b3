"""Books from tables without geometry: each text or web page becomes a page of lines with a fixed, deterministic layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S

#: Page of both adapters, in points.
WIDTH, HEIGHT = 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span(text, size, flags, font="Body"):
    return F.struct(
        text.alias("text"), F.lit(font).alias("font"), size.alias("size"), flags.cast("int").alias("flags"), F.lit(0).alias("color"),
        F.struct(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), F.struct(F.col("x0").alias("x"), F.col("y1").alias("y")).alias("origin"),
    ).cast(S.SPAN)


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of documents: a book for each source, a page for each document (page_no is doc_id), a line for each text line.

    The first line lies in the top band, the last in the bottom band, the rest between them at even distances. Narrow:
    no row moves, whatever share of the documents one source holds.
    """
    cut = documents.select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), F.split("text", "\n").alias("ls"))
    rows = cut.select("book_id", "page_no", F.size("ls").alias("n"), F.posexplode("ls").alias("line_no", "t"))
    step = F.least(F.lit(14.0), F.lit(540.0) / F.greatest(F.col("n") - 2, F.lit(1)))
    y0 = F.when(F.col("line_no") == 0, 40.0).when(F.col("line_no") == F.col("n") - 1, 740.0).otherwise(120.0 + (F.col("line_no") - 1) * step)
    placed = rows.withColumn("y0", y0).withColumn("y1", F.col("y0") + 12.0).withColumn("x0", F.lit(72.0)).withColumn("x1", 72.0 + 5.0 * F.length("t"))
    return placed.select("book_id", "page_no", "line_no", F.array(_span(F.col("t"), F.lit(11.0), F.lit(0))).alias("spans"), "x0", "y0", "x1", "y1", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


#: Type sizes and left edges by tag.
SIZES = {"h1": 22.0, "p": 11.0, "li": 8.0, "div": 8.0, "footer": 8.0, "title": 8.0}


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of web pages: a book for each host (without www., m. and blog.), a page for each web page, a line for each block."""
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1), r"^(?:www|m|blog)\.", "")
    bare = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    cut = pages.select(host.alias("book_id"), F.col("page_id").alias("page_no"), F.split(bare, r"(?=<(?:title|h1|p|li|div|footer)[ >])").alias("bs"))
    rows = cut.select("book_id", "page_no", F.posexplode("bs").alias("b", "raw")).withColumn("tag", F.regexp_extract("raw", r"^<(title|h1|p|li|div|footer)[ >]", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>?", " "), " +", " "))
    rows = rows.where("tag <> ''").withColumn("t", text).where("t <> ''")
    size = F.coalesce(*[F.when(F.col("tag") == k, v) for k, v in SIZES.items()])
    placed = rows.withColumn("line_no", F.col("b").cast("int")).withColumn("size", size).withColumn("y0", 60.0 + 14.0 * (F.col("b") % 48))
    placed = placed.withColumn("y1", F.col("y0") + 12.0).withColumn("x0", F.lit(72.0)).withColumn("x1", 72.0 + 5.0 * F.length("t")).withColumn("bold", F.col("raw").contains("<b>"))
    return placed.select("book_id", "page_no", "line_no", F.array(_span(F.col("t"), F.col("size"), F.when(F.col("bold"), S.BOLD).otherwise(0))).alias("spans"), "x0", "y0", "x1", "y1", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
