"""Notes: parsed from a page's note zone, found in running text, and bound to their markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.spans import label_from_spans
from quire.functions.text import dehyphenated, normalize, note_label, strip

_PAGE = ("book_id", "page_no")
HANGING = 6.0
STEP = 3


def parse_notes(lines: DataFrame) -> DataFrame:
    """book_id, page_no, ord, note_id, label, text of the notes in note-zone lines (with pos).

    In a hanging list (left edges six points apart or more) labels stand left of the middle; else a number opens a note
    if it is the first or goes on by one to three. A text that goes on a sentence opens none; lines before the first
    label are left out. Folded over one page's note lines.
    """
    page = Window.partitionBy(*_PAGE)
    t = strip(F.col("text"))
    spans = label_from_spans()
    from_text = F.when(F.regexp_like(t, F.lit(P.NOTE_LABEL)), F.struct(F.regexp_extract(t, P.NOTE_LABEL, 1).alias("label"), F.regexp_extract(t, P.NOTE_LABEL, 2).alias("rest")))
    rows = lines.withColumn("lo", F.min("x0").over(page)).withColumn("hi", F.max("x0").over(page)).where(t != "")
    rows = rows.withColumn("t", t).withColumn("split", F.coalesce(spans, from_text))
    item = F.struct("pos", "x0", "t", note_label(F.col("split.label")).alias("label"), strip(F.col("split.rest")).alias("rest"), (F.col("split").isNotNull() & ~F.regexp_like("split.rest", F.lit(P.CONTINUES))).alias("may"))
    pages = rows.groupBy(*_PAGE, "lo", "hi").agg(F.array_sort(F.collect_list(item)).alias("ls"))
    number = lambda c: F.when(F.regexp_like(c, F.lit(r"^\d+$")), c.cast("int"))

    def step(acc, x):
        last, notes = acc["last"], acc["notes"]
        n = number(x["label"])
        runs_on = n.isNull() | last.isNull() | ((last < n) & (n <= last + STEP))
        opens = x["may"] & F.when(F.col("hi") - F.col("lo") >= HANGING, x["x0"] <= F.col("lo") + (F.col("hi") - F.col("lo")) * 0.5).otherwise(runs_on)
        tail = F.get(notes, F.size(notes) - 1)
        grown = F.when(F.size(notes) > 0, F.concat(F.slice(notes, 1, F.size(notes) - 1), F.array(F.struct(tail["label"].alias("label"), F.concat(tail["parts"], F.array(x["t"])).alias("parts"))))).otherwise(notes)
        return F.when(opens, F.struct(F.coalesce(n, last).alias("last"), F.concat(notes, F.array(F.struct(x["label"].alias("label"), F.array(x["rest"]).alias("parts")))).alias("notes"))).otherwise(F.struct(last.alias("last"), grown.alias("notes")))

    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<label:string,parts:array<string>>>").alias("notes"))
    out = pages.select(*_PAGE, F.posexplode(F.aggregate("ls", start, step)["notes"]).alias("ord", "n"))
    parts = F.filter(F.transform("n.parts", strip), lambda p: p != "")
    text = normalize(strip(dehyphenated(parts)))
    out = out.select(*_PAGE, F.col("ord").cast("int").alias("ord"), F.col("n.label").alias("label"), text.alias("text")).where("text <> ''")
    return out.select(*_PAGE, "ord", F.concat(F.lit("n"), F.col("page_no").cast("string"), F.lit("-"), F.col("label")).alias("note_id"), "label", "text")


def embedded_markers(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """book_id, page_no, line_no, label: digits fused to a word that name a note of the page. labels: book_id, page_no, label."""
    found = texts.select(*_PAGE, "line_no", F.explode(F.regexp_extract_all("text", F.lit(P.EMBEDDED_MARKER), F.lit(1))).alias("label"))
    return found.join(labels.select(*_PAGE, "label").distinct(), [*_PAGE, "label"], "left_semi")


def resolve(markers: DataFrame, notes: DataFrame, scope: tuple[str, ...] = ("book_id", "ch")) -> DataFrame:
    """markers with target: the note of that id in the chapter, else the only note there with that label, else null (a plain superscript).

    markers: scope, noteref, label. notes: scope, note_id, label.
    """
    by_id = notes.where("note_id is not null").select(*scope, F.col("note_id").alias("id1")).distinct()
    own = notes.where(strip(F.col("label")) != "").groupBy(*scope, strip(F.col("label")).alias("l2")).agg(F.count("*").alias("n"), F.min("note_id").alias("id2")).where("n = 1").drop("n")
    found = markers.join(by_id.withColumn("noteref", F.col("id1")), [*scope, "noteref"], "left").withColumn("l2", strip(F.col("label")))
    return found.join(own, [*scope, "l2"], "left").withColumn("target", F.coalesce("id1", "id2")).drop("id1", "id2", "l2")


def in_label_order(notes: DataFrame, scope: tuple[str, ...] = ("book_id", "ch")) -> DataFrame:
    """notes with place: by number within scope, labels that are no numbers last, ties in order of discovery (page_no, ord)."""
    key = F.when(F.regexp_like("label", F.lit(r"^\d+$")), F.col("label").cast("long")).otherwise(F.lit(10**9))
    return notes.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(key, "page_no", "ord")))
