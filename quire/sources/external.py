"""Sources and capabilities that need optional libraries or programs: PDF pages, OCR words, dictionaries, EPUB parts.

Each is gated: available() says whether this installation has it, and reading without it raises a clear error.
"""

from __future__ import annotations

import importlib.util
import io
import re
import shutil
import subprocess
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions import patterns as P


def available(what: str) -> bool:
    """pdf, ocr or dictionary. Asked once on the driver, never by row."""
    if what == "pdf":
        return importlib.util.find_spec("pymupdf") is not None
    if what == "ocr":
        return available("pdf") and importlib.util.find_spec("pytesseract") is not None and shutil.which("tesseract") is not None
    if what == "dictionary":
        return shutil.which("hunspell") is not None
    raise ValueError(what)


def _need(what: str) -> None:
    if not available(what):
        raise RuntimeError(f"this installation has no {what} support")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of PDF files, by Spark's own reader, so that any store works."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("book_id"), "content")


def pdf_lines(files: DataFrame) -> DataFrame:
    """Lines of PDF files: text blocks' lines with their spans, sizes in tenths, empty spans left out."""
    _need("pdf")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for frame in frames:
            for book, content in zip(frame.book_id, frame.content, strict=True):
                rows = []
                with pymupdf.open(stream=bytes(content), filetype="pdf") as doc:
                    for page in doc:
                        found = page.get_text("dict")
                        n = 0
                        for block in found["blocks"]:
                            for line in block.get("lines", ()):
                                spans = [_pdf_span(s) for s in line["spans"] if s["text"]]
                                if spans:
                                    rows.append((book, page.number, n, spans, *map(float, line["bbox"]), float(found["width"]), float(found["height"])))
                                    n += 1
                yield pd.DataFrame(rows, columns=["book_id", "page_no", "line_no", "spans", "x0", "y0", "x1", "y1", "width", "height"])

    return files.mapInPandas(run, S.LINES)


def _pdf_span(s: dict) -> dict:
    box = dict(zip(("x0", "y0", "x1", "y1"), map(float, s["bbox"]), strict=True))
    return {"text": s["text"], "font": s["font"], "size": round(s["size"], 1), "flags": int(s["flags"]), "color": int(s["color"]), "bbox": box, "origin": {"x": float(s["origin"][0]), "y": float(s["origin"][1])}}


def page_images(files: DataFrame, pages: str = "first", zoom: float = 2.0) -> DataFrame:
    """Pages as rasters: book_id, page_no, ext, data. pages: first (covers) or all; JPEG where it can be made, else PNG."""
    _need("pdf")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for frame in frames:
            for book, content in zip(frame.book_id, frame.content, strict=True):
                with pymupdf.open(stream=bytes(content), filetype="pdf") as doc:
                    for page in list(doc)[: 1 if pages == "first" else None]:
                        raster = page.get_pixmap(matrix=pymupdf.Matrix(zoom, zoom))
                        try:
                            ext, data = "jpeg", raster.tobytes("jpeg")
                        except Exception:  # the library's own errors vary by version
                            ext, data = "png", raster.tobytes("png")
                        yield pd.DataFrame([(book, page.number, ext, data)], columns=["book_id", "page_no", "ext", "data"])

    return files.mapInPandas(run, "book_id string, page_no long, ext string, data binary")


def ocr_words(files: DataFrame, lang: str = "eng", dpi: int = 300, min_conf: float = 40.0) -> DataFrame:
    """Word boxes in points that OCR reads on each page; words below min_conf are left out, those without a confidence kept."""
    _need("ocr")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf
        import pytesseract
        from PIL import Image

        for frame in frames:
            for book, content in zip(frame.book_id, frame.content, strict=True):
                with pymupdf.open(stream=bytes(content), filetype="pdf") as doc:
                    for page in doc:
                        image = Image.open(io.BytesIO(page.get_pixmap(dpi=dpi).tobytes("png")))
                        d = pytesseract.image_to_data(image, lang=lang, output_type=pytesseract.Output.DATAFRAME)
                        d = d[d.text.notna() & (d.text.astype(str).str.strip() != "")].reset_index(drop=True)
                        f = 72 / dpi
                        yield pd.DataFrame({
                            "book_id": book, "page_no": page.number, "word_no": range(len(d)), "text": d.text.astype(str), "x0": d.left * f, "y0": d.top * f, "x1": (d.left + d.width) * f,
                            "y1": (d.top + d.height) * f, "conf": d.conf.astype(float), "block_num": d.block_num, "par_num": d.par_num, "line_num": d.line_num,
                        })

    words = files.mapInPandas(run, S.WORDS)
    return words.where(confident(min_conf))


def confident(min_conf: float = 40.0):
    return (F.col("conf") < 0) | (F.col("conf") >= min_conf)


def ocr_lines(words: DataFrame, width: float, height: float) -> DataFrame:
    """Lines from OCR words: one for each (block, paragraph, line), words from left to right, size the upper median height in tenths."""
    key = ["book_id", "page_no", "block_num", "par_num", "line_num"]
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    ordered = F.array_sort(F.collect_list(F.struct("x0", "word_no", "text")))
    heights = F.sort_array(F.collect_list(F.col("y1") - F.col("y0")))
    rows = words.where(confident()).groupBy(*key).agg(*box, F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), heights.alias("hs"))
    size = F.bround(F.element_at("hs", (F.size("hs") / 2).cast("int") + 1), 1)
    span = F.struct(F.col("text"), F.lit("OCR").alias("font"), size.alias("size"), F.lit(0).alias("flags"), F.lit(0).alias("color"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), F.struct(F.col("x0").alias("x"), F.col("y1").alias("y")).alias("origin")).cast(S.SPAN)
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("book_id", "page_no").orderBy("block_num", "par_num", "line_num")) - 1).cast("int")
    return rows.select("book_id", "page_no", place.alias("line_no"), F.array(span).alias("spans"), "x0", "y0", "x1", "y1", F.lit(width).alias("width"), F.lit(height).alias("height"))


def find_dictionary(lang: str, folders=P.DICTIONARY_FOLDERS) -> str | None:
    """Stem of the first dictionary for this language code, e.g. ro_RO; three-letter codes by their two-letter ones."""
    code = P.LANGUAGE_CODES.get(lang.lower(), lang.lower())[:2]
    stems = (f.stem for d in folders if Path(d).is_dir() for f in sorted(Path(d).glob("*.dic")))
    return next((s for s in stems if s.lower().startswith(code)), None)


def known_words(words: DataFrame, lang: str, timeout: int = 60) -> DataFrame:
    """lang, word: the distinct words that the installed dictionary knows, asked in batches."""
    _need("dictionary")
    dictionary = find_dictionary(lang)
    if dictionary is None:
        raise RuntimeError(f"no dictionary for {lang}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = list(frame.word)
            done = subprocess.run(["hunspell", "-l", "-d", dictionary], input="\n".join(asked), capture_output=True, text=True, timeout=timeout)
            wrong = set(done.stdout.split())
            yield pd.DataFrame({"lang": lang, "word": [w for w in asked if w not in wrong]})

    return words.select("word").distinct().mapInPandas(run, S.LEXICON)


def epub_parts(spark: SparkSession, path: str) -> DataFrame:
    """book_id, part, content of every member of EPUB files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select(F.col("path").alias("book_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in zip(frame.book_id, frame.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        yield pd.DataFrame([(book, name, z.read(name))], columns=["book_id", "part", "content"])

    return files.mapInPandas(run, "book_id string, part string, content binary")


def is_pdf_name(name: str) -> bool:
    return bool(re.search(r"\.pdf$", name, re.I))
