"""The flow of a book's elements: images and text in order, split headings and paragraphs joined, page breaks put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions import patterns as P
from quire.functions.text import drop_break_hyphen, ends_hyphenated, ends_sentence, n_words, rstrip, starts_lower, strip
from quire.operators.carry import previous, running_sum

_PAGE = ("book_id", "page_no")
COLUMNS = ("book_id", "page_no", "cls", "ord", "kind", "level", "size", "anchor", "runs", "table_rows", "image_id")


def runs_text(runs="runs") -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def plain_run(text: Column) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("sup"), F.lit(None).cast("string").alias("noteref"), F.lit(None).cast("string").alias("href"))).cast(f"array<{S.RUN}>")


def picture_elements(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Image elements: 80 pixels or more each way, no scan of the whole page (92 %), on page 0 none over half of it (the cover)."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / (F.col("width") * F.col("height"))
    sized = images.join(pages.select(*_PAGE, "width", "height"), list(_PAGE))
    kept = sized.where((F.col("px_width") >= P.MIN_IMAGE_PX) & (F.col("px_height") >= P.MIN_IMAGE_PX) & ~(area > 0.92) & ~((F.col("page_no") == 0) & (area > 0.5)))
    none = F.lit(None)
    return kept.select(
        *_PAGE, F.lit(1).alias("cls"), F.col("image_no").cast("int").alias("ord"), F.lit("image").alias("kind"), F.lit(0).alias("level"), F.lit(0.0).alias("size"), none.cast("string").alias("anchor"),
        F.array().cast(f"array<{S.RUN}>").alias("runs"), none.cast("array<array<string>>").alias("table_rows"), "image_id",
    )


def flow(text: DataFrame, images: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Elements of text followed by the images of each page."""
    out = text.withColumn("cls", F.lit(0)).select(*COLUMNS)
    return out if images is None else out.unionByName(picture_elements(images, pages))


def drop_pages(elements: DataFrame, classes: DataFrame, confidence: float = 0.80) -> DataFrame:
    """Elements without those of pages that are contents lists with this confidence or more."""
    gone = classes.where((F.col("page_type") == "contents") & (F.col("confidence") >= confidence)).select(*_PAGE)
    return elements.join(gone, list(_PAGE), "left_anti")


def merge_headings(elements: DataFrame) -> DataFrame:
    """Headings that follow one another on a page become one where the first is a number or a division's label, or the same size runs on.

    The result of a join decides about the next, so each run of headings on a page is folded in order.
    """
    page = Window.partitionBy(*_PAGE).orderBy("cls", "ord")
    heading = F.col("kind") == "heading"
    rows = elements.withColumn("text", strip(runs_text())).withColumn("new", F.when(heading & F.coalesce(F.lag("kind").over(page) == "heading", F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("isle", F.sum("new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where(heading).groupBy(*_PAGE, "isle").agg(F.array_sort(F.collect_list(F.struct("ord", "text", F.col("level").cast("int").alias("level"), "size", F.lit(1).alias("n")))).alias("hs"))
    like = lambda c, p: F.regexp_like(c, F.lit(p))

    def step(acc, x):
        prev = F.get(acc, F.size(acc) - 1)
        t = strip(prev["text"])
        numbered = like(t, P.BARE_NUMBER) | (like(t, P.DIVISION) & (n_words(t) <= 4))
        same = (prev["size"] <= 0) | (x["size"] <= 0) | (F.abs(prev["size"] - x["size"]) <= 1.0)
        goes_on = same & ~like(x["text"], P.NUMBERED) & ~like(t, r"[.?!:;]$") & (F.length(t) < 160)
        nine = lambda v: F.when(v == 0, 9).otherwise(v)
        joined = F.struct(prev["ord"].alias("ord"), F.concat(t, F.lit(" "), x["text"]).alias("text"), F.least(nine(prev["level"]), nine(x["level"])).alias("level"), F.when(x["size"] > 0, x["size"]).otherwise(prev["size"]).alias("size"), (prev["n"] + 1).alias("n"))
        return F.when((F.size(acc) > 0) & (numbered | goes_on), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    kind = runs.schema["hs"].dataType.simpleString()
    merged = runs.select(*_PAGE, F.explode(F.aggregate("hs", F.array().cast(kind), step)).alias("m")).select(*_PAGE, F.col("m.ord").alias("ord"), F.col("m.text").alias("m_text"), F.col("m.level").alias("m_level"), F.col("m.size").alias("m_size"), F.col("m.n").alias("m_n"))
    heads = rows.where(heading).join(merged, [*_PAGE, "ord"])
    heads = heads.withColumn("runs", F.when(F.col("m_n") > 1, plain_run(F.col("m_text"))).otherwise(F.col("runs"))).withColumn("level", F.col("m_level")).withColumn("size", F.col("m_size"))
    return rows.where(~heading).select(*COLUMNS).unionByName(heads.select(*COLUMNS))


def merge_paragraphs(elements: DataFrame) -> DataFrame:
    """Paragraphs cut by a page turn (next one in lower case, no sentence end), or by a hyphen anywhere, become one.

    Whether a text runs on is seen from neighbours alone; on the page where a chain of such texts begins only a hyphen
    joins, on later pages all do. The chain's page is known from the chain's first element.
    """
    rows = elements.withColumn("text", runs_text())
    rows = previous(rows, ["kind", "text"])
    para = (F.col("kind") == "paragraph") & F.coalesce(F.col("p_kind") == "paragraph", F.lit(False))
    goes_on = para & (strip(F.col("p_text")) != "") & (strip(F.col("text")) != "") & ~ends_sentence(F.col("p_text")) & starts_lower(F.col("text"))
    rows = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("hyphen", F.coalesce(ends_hyphenated(F.col("p_text")), F.lit(False)))
    rows = running_sum(rows, F.when(F.col("goes_on"), 0).otherwise(1), "chain")
    chain = Window.partitionBy("book_id", "chain")
    rows = rows.withColumn("chain_page", F.min("page_no").over(chain))
    joins = F.col("goes_on") & (F.col("hyphen") | (F.col("page_no") != F.col("chain_page")))
    w = chain.orderBy("page_no", "cls", "ord")
    rows = rows.withColumn("g", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("page_no", "cls", "ord", "hyphen", "runs")
    out = rows.groupBy("book_id", "chain", "g").agg(F.array_sort(F.collect_list(item)).alias("xs"), F.min_by(F.struct("kind", "level", "size", "anchor", "table_rows", "image_id"), F.struct("page_no", "cls", "ord")).alias("e"))

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        put = lambda t: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(last.withField("text", t)))
        plain = last["noteref"].isNull() & ~last["sup"]
        spaced = F.when(plain, put(F.concat(rstrip(last["text"]), F.lit(" ")))).otherwise(F.concat(acc, plain_run(F.lit(" "))))
        glued = F.when(plain, put(drop_break_hyphen(last["text"]))).otherwise(acc)
        return F.concat(F.when(F.size(acc) == 0, acc).when(x["hyphen"], glued).otherwise(spaced), x["runs"])

    first = F.get("xs", F.lit(0))
    runs = F.when(F.size("xs") == 1, first["runs"]).otherwise(F.aggregate("xs", F.array().cast(f"array<{S.RUN}>"), step))
    return out.select("book_id", first["page_no"].alias("page_no"), first["cls"].alias("cls"), first["ord"].alias("ord"), F.col("e.kind").alias("kind"), F.col("e.level").alias("level"), F.col("e.size").alias("size"), F.col("e.anchor").alias("anchor"), runs.alias("runs"), F.col("e.table_rows").alias("table_rows"), F.col("e.image_id").alias("image_id"))


def page_breaks(elements: DataFrame) -> DataFrame:
    """Elements with a page_break element (anchor page-N, level N, N from 1) before the first one of each new page but the book's first."""
    page = elements.groupBy(*_PAGE).agg(F.min(F.struct("cls", "ord")).alias("first"))
    turned = page.withColumn("before", F.lag("page_no").over(Window.partitionBy("book_id").orderBy("page_no"))).where("before is not null")
    n = F.col("page_no") + 1
    none = F.lit(None)
    rows = turned.select(
        *_PAGE, F.lit(-1).alias("cls"), F.lit(0).alias("ord"), F.lit("page_break").alias("kind"), n.cast("int").alias("level"), F.lit(0.0).alias("size"), F.concat(F.lit("page-"), n.cast("string")).alias("anchor"),
        F.array().cast(f"array<{S.RUN}>").alias("runs"), none.cast("array<array<string>>").alias("table_rows"), none.cast("string").alias("image_id"),
    )
    return elements.select(*COLUMNS).unionByName(rows)
