"""EPUB packages: each book's rendered parts zipped by the executor that holds them."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import media_type
from quire.sinks.html import STYLESHEET

_CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'


def image_hrefs(elements: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, image_href, media, numbered in order of the book's image elements."""
    from pyspark.sql import Window

    used = elements.where("kind = 'image'").select("book_id", "image_id", "page_no", "ord")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("page_no", "ord"))
    named = used.withColumn("n", n).join(images.select("image_id", "ext"), "image_id")
    ext = F.regexp_replace(F.lower("ext"), r"^\.+", "")
    return named.select("image_id", F.concat(F.lit("images/img_"), F.col("n").cast("string"), F.lit("."), ext).alias("image_href"), media_type(F.col("ext")).alias("media"))


def pack(book: str, title: str, author: str, language: str, chapters: list[tuple[int, str, str]], subheads: list[tuple[int, str, str]], images: list[tuple[str, str, bytes]], cover: tuple[str, bytes] | None = None) -> bytes:
    """One EPUB 3 file. chapters: number, title, XHTML; subheads: chapter, anchor, title; images: href, media type, data."""
    name = "chap_{:03d}.xhtml".format
    ident = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, book)}"
    inner = {n: "".join(f'<li><a href="{name(n)}#{escape(a)}">{escape(t)}</a></li>' for c, a, t in subheads if c == n) for n, _, _ in chapters}
    items = "".join(f'<li><a href="{name(n)}">{escape(t)}</a>{f"<ol>{inner[n]}</ol>" if inner[n] else ""}</li>' for n, t, _ in chapters)
    nav = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc" id="toc"><ol>{items}</ol></nav></body></html>\n'
    points = "".join(f'<navPoint id="c{n}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{name(n)}"/></navPoint>' for i, (n, t, _) in enumerate(chapters))
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{ident}"/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>\n'
    files = [(f"images/cover.{cover[0]}", f"image/{cover[0]}", cover[1])] if cover else []
    manifest = "".join(f'<item id="i{k}" href="{h}" media-type="{m}"{" properties=" + chr(34) + "cover-image" + chr(34) if cover and not k else ""}/>' for k, (h, m, _) in enumerate([*files, *images]))
    manifest += "".join(f'<item id="c{n}" href="{name(n)}" media-type="application/xhtml+xml"/>' for n, _, _ in chapters)
    spine = "".join(f'<itemref idref="c{n}"/>' for n, _, _ in chapters)
    opf = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{ident}</dc:identifier><dc:title>{escape(title)}</dc:title>'
        f"<dc:language>{escape(language)}</dc:language>{f'<dc:creator>{escape(author)}</dc:creator>' if author else ''}</metadata><manifest>"
        f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{manifest}</manifest><spine toc="ncx">{spine}</spine></package>\n'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", _CONTAINER)
        for part, content in (("content.opf", opf), ("nav.xhtml", nav), ("toc.ncx", ncx), ("style.css", STYLESHEET), *((name(n), h) for n, _, h in chapters), *((h, d) for h, _, d in [*files, *images])):
            z.writestr(f"EPUB/{part}", content)
    return out.getvalue()


def epubs(books: DataFrame, chapters: DataFrame, subheads: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """book_id, epub (bytes). books: book_id, title, author, language; chapters: book_id, ch, title, html; images: book_id, image_href, media, data.

    The unit of packing is one book, which a reader holds in memory as well.
    """
    c = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ch", "title", "html"))).alias("cs"))
    s = subheads.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ch", "k", "anchor", "title"))).alias("ss"))
    rows = books.select("book_id", "title", "author", "language").join(c, "book_id").join(s, "book_id", "left")
    if images is None:
        rows = rows.withColumn("ims", F.array().cast("array<struct<image_href:string,media:string,data:binary>>"))
    else:
        rows = rows.join(images.groupBy("book_id").agg(F.collect_list(F.struct("image_href", "media", "data")).alias("ims")), "book_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples():
                parts = [(int(x["ch"]), x["title"], x["html"]) for x in r.cs]
                subs = [(int(x["ch"]), x["anchor"], x["title"]) for x in (r.ss if r.ss is not None else ())]
                pics = [(x["image_href"], x["media"], bytes(x["data"])) for x in (r.ims if r.ims is not None else ())]
                made.append(pack(r.book_id, r.title, r.author, r.language, parts, subs, pics))
            yield pd.DataFrame({"book_id": frame.book_id, "epub": made})

    return rows.mapInPandas(run, "book_id string, epub binary")


def without_page_list(nav):
    """A navigation document's text (column) without its page list."""
    return F.regexp_replace(nav, r'(?s)\s*<nav[^>]*epub:type="page-list".*?</nav>', "")
