"""Small tables for tests: lines from texts and spans, rows of elements."""

from quire import schema as S
from quire.functions.spans import with_text


def span(text, size=11.0, flags=0, font="Body", x0=72.0, y=112.0):
    return {"text": text, "font": font, "size": float(size), "flags": flags, "color": 0, "bbox": {"x0": float(x0), "y0": 100.0, "x1": x0 + 5.0 * len(text), "y1": 112.0}, "origin": {"x": float(x0), "y": float(y)}}


def line(n, parts, x0=72.0, y0=None, x1=None, page=0, book="b", height=12.0, size=11.0, page_height=792.0):
    parts = [span(parts, size)] if isinstance(parts, str) else parts
    y0 = 100.0 + 12.0 * n if y0 is None else y0
    x1 = x0 + 5.0 * sum(len(p["text"]) for p in parts) if x1 is None else x1
    return (book, page, n, parts, float(x0), float(y0), float(x1), float(y0 + height), 612.0, float(page_height))


def lines(spark, rows):
    return with_text(spark.createDataFrame(rows, S.LINES))


def element(k, kind, text, level=0, size=0.0, page=0, book="b", cls=0):
    run = {"text": text, "bold": False, "italic": False, "sup": False, "noteref": None, "href": None}
    return (book, page, cls, k, kind, level, float(size), None, [run] if text else [], None, None)


ELEMENTS = f"book_id string, page_no long, cls int, ord int, kind string, level int, size double, anchor string, runs array<{S.RUN}>, table_rows array<array<string>>, image_id string"


def elements(spark, rows):
    return spark.createDataFrame(rows, ELEMENTS)
