"""Scalar text functions as Spark columns: typography, hyphens, running-head keys, page predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P


def strip(c) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def rstrip(c) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lstrip(c) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def n_words(c) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def normalize(c) -> Column:
    """Ligatures to letters, doubled single quotes to double ones, fraction slashes to fractions, runs of spaces to one."""
    c = F.col(c) if isinstance(c, str) else c
    for glyph, letters in P.LIGATURES.items():
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    for pair, quote in (("‘‘", "“"), ("’’", "”"), ("``", "“"), ("''", "”")):
        c = F.replace(c, F.lit(pair), F.lit(quote))
    for written, glyph in P.FRACTIONS.items():
        c = F.regexp_replace(c, written + r"(?!\d)", glyph)
    c = F.regexp_replace(c, r"(?U)(\d)⁄(\d)(?!\d)", "$1/$2")
    return F.regexp_replace(c, "  +", " ")


def ends_hyphenated(c) -> Column:
    return F.regexp_like(c, F.lit(rf"(?U)[{P.BREAK_HYPHENS[1:]}\-]\s*$"))


def drop_break_hyphen(c) -> Column:
    return F.regexp_replace(rstrip(c), rf"[{P.BREAK_HYPHENS[1:]}\-]$", "")


def starts_lower(c) -> Column:
    return F.regexp_like(c, F.lit(r"(?U)^\s*\p{Ll}"))


def ends_sentence(c) -> Column:
    tail = rstrip(c)
    return reduce(lambda a, b: a | b, (F.endswith(tail, F.lit(mark)) for mark in P.SENTENCE_END))


def running_key(c) -> Column:
    """What running heads on different pages share: trimmed, lower case, each run of digits one #."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)\d+", "#"), r"(?U)\s+", " ")


def note_label(c) -> Column:
    return strip(F.regexp_replace(c, r"[().]", ""))


def dehyphenated(parts) -> Column:
    """Parts joined by a space, or without their break hyphen where the next begins in lower case."""
    step = lambda a, b: F.when(a == "", b).when(ends_hyphenated(a) & starts_lower(b), F.concat(drop_break_hyphen(a), lstrip(b))).otherwise(F.concat(a, F.lit(" "), b))
    return F.aggregate(parts, F.lit(""), step)


def is_garbled(c) -> Column:
    """More than four control characters in a hundred, line breaks and tabs apart."""
    odd = F.length(c) - F.length(F.regexp_replace(c, r"[\p{Cc}&&[^\t\n\r]]", ""))
    return (F.length(c) > 0) & (odd / F.greatest(F.length(c), F.lit(1)) > 0.04)


def is_other_script(c) -> Column:
    """Four letters at least, and more than a fifth of them not Latin."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    other = F.regexp_count(c, F.lit(r"[\p{L}&&[^\p{IsLatin}]]"))
    return (letters >= 4) & (other > letters * 0.2)


def is_debris(c) -> Column:
    """One or two characters without a digit or a basic Latin letter."""
    t = strip(c)
    return F.length(t).between(1, 2) & ~F.regexp_like(t, F.lit(r"[\p{Nd}²³¹a-zA-Z]"))


def is_all_caps(c) -> Column:
    return F.regexp_like(c, F.lit(r"\p{Lu}")) & ~F.regexp_like(c, F.lit(r"\p{Ll}"))


def safe_stem(c) -> Column:
    """A file stem: other characters than word characters, hyphens, dots and spaces become _; book if nothing is left."""
    t = F.trim(F.regexp_replace(c, r"(?U)[^\w\-. ]+", "_"))
    return F.when(t == "", "book").otherwise(F.coalesce(t, F.lit("book")))


def media_type(ext) -> Column:
    key = F.lower(F.regexp_replace(ext, r"^\.+", ""))
    found = reduce(lambda c, kv: c.when(key == kv[0], kv[1]), P.IMAGE_MEDIA.items(), F.when(F.lit(False), ""))
    return F.coalesce(found, F.lit("image/png"))


def escape(c) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quoted(c) -> Column:
    """An attribute value in quotes: double ones, unless only these occur in it."""
    e = F.replace(F.replace(F.replace(escape(c), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;")), F.lit("\t"), F.lit("&#9;"))
    return F.when(~F.contains(e, F.lit('"')), F.concat(F.lit('"'), e, F.lit('"'))).when(~F.contains(e, F.lit("'")), F.concat(F.lit("'"), e, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(e, F.lit('"'), F.lit("&quot;")), F.lit('"')))
