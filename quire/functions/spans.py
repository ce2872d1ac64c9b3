"""Functions of a line's spans, as Spark columns over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions import patterns as P
from quire.functions.text import strip


def flag(s: Column, bit: int) -> Column:
    return s["flags"].bitwiseAND(bit) != 0


def is_bold(s: Column) -> Column:
    return flag(s, S.BOLD) | F.regexp_like(F.lower(s["font"]), F.lit("bold|black"))


def is_italic(s: Column) -> Column:
    return flag(s, S.ITALIC) | F.regexp_like(F.lower(s["font"]), F.lit("italic|oblique"))


def is_superscript(s: Column) -> Column:
    return flag(s, S.SUPERSCRIPT)


def is_mono(s: Column) -> Column:
    return flag(s, S.MONO)


def filled(s: Column) -> Column:
    return F.regexp_like(s["text"], F.lit(r"(?U)\S"))


def line_text(spans="spans") -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def dominant_size(spans="spans") -> Column:
    """Size of the longest span, the first among equals; 0 without spans."""
    best = F.aggregate(
        spans,
        F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("size")),
        lambda a, s: F.when(F.length(s["text"]) > a["n"], F.struct(F.length(s["text"]).alias("n"), s["size"].alias("size"))).otherwise(a),
    )
    return best["size"]


def metrics(spans="spans", y1="y1") -> Column:
    """struct(size, baseline): size of the longest filled span; most frequent baseline (tenths) of spans of about that size, else the line's bottom."""
    size = dominant_size(F.filter(spans, filled))
    near = F.transform(F.filter(spans, lambda s: filled(s) & (F.abs(s["size"] - size) <= 0.3)), lambda s: F.bround(s["origin"]["y"], 1))
    counted = F.transform(F.array_distinct(near), lambda v: F.struct(F.size(F.filter(near, lambda w: w == v)).alias("n"), (-F.array_position(near, v)).alias("first"), v.alias("y")))
    return F.struct(size.alias("size"), F.coalesce(F.array_max(counted)["y"], F.col(y1)).alias("baseline"))


def is_raised(s: Column, line: Column) -> Column:
    return (s["size"] <= line["size"] - 0.5) & (s["origin"]["y"] <= line["baseline"] - 0.12 * line["size"])


def markers(spans="spans", y1="y1") -> Column:
    """array of struct(i, label): short raised spans that are numbers or note symbols and no part of a fraction (i from 0)."""
    line = metrics(spans, y1)
    all_ = F.col(spans) if isinstance(spans, str) else spans

    def one(s: Column, i: Column) -> Column:
        t = strip(s["text"])
        after = F.filter(F.slice(all_, i + 2, F.size(all_)), filled)
        before = F.array_join(F.transform(F.slice(all_, 1, F.greatest(i, F.lit(0))), lambda x: x["text"]), "")
        fraction = F.coalesce(F.regexp_like(F.get(after, F.lit(0))["text"], F.lit(r"(?U)^\s*[⁄/]")), F.lit(False)) | F.regexp_like(before, F.lit(r"(?U)\d\s*$"))
        number = F.regexp_like(t, F.lit(P.MARKER_TEXT)) & F.regexp_like(t, F.lit(r"(?U)\d"))
        shape = t.isin(*P.NOTE_SYMBOLS) | (number & ~fraction)
        return F.struct(i.alias("i"), t.alias("label"), (shape & (is_superscript(s) | is_raised(s, line))).alias("ok"))

    kept = F.filter(F.transform(all_, one), lambda m: m["ok"])
    return F.transform(kept, lambda m: F.struct(m["i"].alias("i"), m["label"].alias("label")))


def label_from_spans(spans="spans", y1="y1") -> Column:
    """struct(label, rest) if the line's first filled span is a raised or smaller note mark, else null."""
    line = metrics(spans, y1)
    full = F.filter(spans, filled)
    first = F.get(full, F.lit(0))
    t = strip(first["text"])
    rest = F.array_join(F.transform(F.slice(full, 2, F.greatest(F.size(full), F.lit(1))), lambda s: s["text"]), "")
    ok = F.regexp_like(t, F.lit(P.MARKER_TEXT)) & (t != "") & (is_superscript(first) | (first["size"] <= line["size"] - 0.5))
    return F.when(ok, F.struct(t.alias("label"), rest.alias("rest")))


def with_text(lines: DataFrame) -> DataFrame:
    """lines with text (all spans), size (dominant) and h (height)."""
    return lines.withColumn("text", line_text()).withColumn("size", dominant_size()).withColumn("h", F.col("y1") - F.col("y0"))
