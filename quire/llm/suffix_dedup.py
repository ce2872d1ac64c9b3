"""Removal of repeated 100-byte strings by bucket-pointer refinement of suffix buckets.

The suffixes of all texts are put into buckets by q-gram (q = 25) and refined: a bucket of 25-grams is parted by the
bucket identifiers 25 bytes on, which gives buckets of 50-grams; these new identifiers are reused 50 bytes on, which
gives buckets of 100-byte strings. Buckets of one suffix drop out at each level. Within a final bucket the suffix with
the smallest (doc_id, start) stays and the others mark 100 bytes each for removal.

To spread this over a cluster, the first level is indexed by winnowing: of the 76 25-grams in any 100-byte string the
one with the least hash is its anchor, so equal strings have equal anchors at the same place, and each start of a string
belongs to one anchor. Anchors whose 25-gram occurs once leave with all their suffixes; the others are cut out with
their context and meet by 25-gram, where the refinement goes on. A 25-gram with very many occurrences is not gathered:
its strings are refined singly, by aggregation on the identifiers of all levels at once.

Identifiers are 64-bit fingerprints of the 25-grams; two strings are equal where four of them are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, mix64, powers, prefix_hash, row_pieces, text_bytes

LENGTH = 100
GRAM = 25
WINDOW = LENGTH - GRAM + 1
#: Anchors that are gathered in one partition on average, and occurrences of a 25-gram above which it is not gathered.
PARTITION_ANCHORS = 40_000
HOT_ANCHORS = 100_000
#: Spark's limit for the buckets of a table, and as many partitions as one exchange should have.
MOST_PARTITIONS = 100_000
#: Bytes of one text that are winnowed at a time; longer texts are worked through in overlapping stretches.
STRETCH = 1 << 20

_U = np.uint64
_PLACE = _U((1 << 22) - 1)


def grams(data: np.ndarray) -> np.ndarray:
    """Fingerprint of the 25-gram at each byte."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = prefix_hash(data, False)
    return mix64((p[GRAM:] - p[:-GRAM]) * powers(len(data))[0][:n])


def winnow(data: np.ndarray, off: np.ndarray):
    """Anchors of the texts: fingerprint, row, first start and number of starts that belong to each."""
    if len(data) < LENGTH:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    h = grams(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if WINDOW - size:
        least = np.minimum(least[: size - WINDOW], least[WINDOW - size :])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.arange(len(least))
    start = start[row[start] == row[start + LENGTH - 1]]
    if not len(start):
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.empty(len(start), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    r = row[start[at]]
    return h[anchor[at]], r, start[at] - off[r], np.diff(np.append(at, len(start)))


def stretches(data: np.ndarray, off: np.ndarray):
    """The texts of a piece as they are, or one long text in overlapping stretches: bytes, offsets, rows' first byte."""
    if len(off) != 2 or len(data) <= STRETCH:
        yield data, off, 0
        return
    for i in range(0, len(data) - LENGTH + 1, STRETCH):
        part = data[i : i + STRETCH + LENGTH - 1]
        yield part, np.array([0, len(part)]), i


def anchors(texts: DataFrame) -> DataFrame:
    """h, doc_id, start, span: each anchor with the starts of 100-byte strings that belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            at = 0
            for part, data, off in row_pieces(batch, "text"):
                own = ids[at : at + part.num_rows]
                at += part.num_rows
                for bytes_, offsets, base in stretches(data, off):
                    h, row, start, span = winnow(bytes_, offsets)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own[row]), pa.array((start + base).astype(np.int32)), pa.array(span.astype(np.int16))], ["h", "doc_id", "start", "span"])

    return texts.select("doc_id", "text").mapInArrow(run, "h long, doc_id long, start int, span short")


def refine(context: np.ndarray, off: np.ndarray, span: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Which 100-byte strings occur earlier: doc_id, first byte and end of each stretch of bytes to remove.

    context i holds span[i] strings, which start at its first bytes; in its document it starts at start[i].
    """
    if not len(span):
        return (np.empty(0, np.int64),) * 3
    id25 = grams(context)
    owner = np.repeat(np.arange(len(span)), span)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(span) - span, span)
    p = off[:-1][owner] + inner
    # 50-gram buckets at the strings' starts and middles, by the pointers of two 25-gram buckets
    both = np.concatenate((p, p + 2 * GRAM))
    pair = mix64(id25[both] ^ mix64(id25[both + GRAM]))
    b50, alone = _buckets(pair)
    n = len(p)
    live = np.flatnonzero(~(alone[:n] | alone[n:]))
    # 100-byte buckets by the new pointers
    key = b50[:n][live].astype(np.uint64) << _U(32) | b50[n:][live].astype(np.uint64)
    b100, alone = _buckets(key)
    live, b100 = live[~alone], b100[~alone]
    d, s = doc[owner[live]], start[owner[live]] + inner[live]
    order = np.lexsort((s, d, b100))
    later = np.empty(len(order), bool)
    if len(order):
        ranked = b100[order]
        later[0] = False
        later[1:] = ranked[1:] == ranked[:-1]
    gone = np.sort(live[order[later]])
    d, s = doc[owner[gone]], start[owner[gone]] + inner[gone]
    # neighbouring starts of one context make one stretch
    new = np.ones(len(gone), bool)
    new[1:] = (owner[gone][1:] != owner[gone][:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(gone)) - 1
    return d[at], s[at], s[end] + LENGTH if len(at) else s[at]


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers in key order, and which places are alone in their bucket."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.cumsum(new) - 1
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = number
    return out, size[out] == 1


_SPANS = "starts array<int>, spans array<short>, hs array<long>"


def _cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, doc_id, start, span, context: the wanted anchors with the bytes that their strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            buffer = data.tobytes()
            lists = [batch.column(i) for i in (2, 3, 4)]
            count = np.diff(np.asarray(lists[0].offsets))
            start, span, h = (np.asarray(x.flatten()) for x in lists)
            row = np.repeat(np.arange(batch.num_rows), count)
            first = off[:-1][row] + start
            last = first + span + (LENGTH - 1)
            docs = np.asarray(batch.column(0), np.int64)[row]
            for i in range(0, len(row), 20_000):
                j = min(i + 20_000, len(row))
                cut = pa.array([buffer[a:b] for a, b in zip(first[i:j].tolist(), last[i:j].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h[i:j]), pa.array(docs[i:j]), pa.array(start[i:j]), pa.array(span[i:j]), cut], ["h", "doc_id", "start", "span", "context"])

    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "span", "h")).alias("x")).select(F.col("doc_id").alias("d"), F.col("x.start").alias("starts"), F.col("x.span").alias("spans"), F.col("x.h").alias("hs"))
    rows = texts.join(by_doc, F.col("doc_id") == F.col("d")).select("doc_id", "text", "starts", "spans", "hs")
    return rows.mapInArrow(run, "h long, doc_id long, start int, span short, context binary")


def _repeats(contexts: DataFrame, partitions: int) -> DataFrame:
    """doc_id, a, b: bytes to remove, from the refinement of each partition's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        # a large partition is worked through bucket by bucket, about PARTITION_ANCHORS at a time
        h = table.column(0).to_numpy()
        order = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        wanted = np.searchsorted(edges, np.arange(0, len(h), PARTITION_ANCHORS))
        cuts = np.unique(edges[wanted[wanted < len(edges)]])
        for i, j in zip(cuts, [*cuts[1:], len(h)], strict=True):
            yield _repeats_of(table if len(cuts) == 1 else table.take(pa.array(order[i:j])))

    return contexts.repartition(partitions, "h").mapInArrow(run, "doc_id long, a int, b int")


def _repeats_of(table: pa.Table) -> pa.RecordBatch:
    """The bytes to remove that the buckets in this table show."""
    doc, start, span = (table.column(i).to_numpy() for i in (1, 2, 3))
    h = table.column(0).to_numpy()
    column = table.column(4).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data, off = text_bytes(column)
    # equal contexts of a bucket: all but the earliest are repeats as a whole, and only that one is refined
    p = prefix_hash(data, False)
    whole = mix64((p[off[1:]] - p[off[:-1]]) * powers(len(data) + 1)[0][off[:-1]] ^ mix64(h.view(np.uint64) + span.astype(np.uint64)))
    order = np.lexsort((start, doc, whole))
    ranked = whole[order]
    first = np.ones(len(order), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    copies, keep = order[~first], np.sort(order[first])
    size = np.diff(off)[keep]
    new = np.concatenate(([0], np.cumsum(size)))
    pos = np.arange(new[-1]) - np.repeat(new[:-1], size) + np.repeat(off[:-1][keep], size)
    d, a, b = refine(data[pos], new, span[keep].astype(np.int64), doc[keep], start[keep].astype(np.int64))
    d = np.concatenate((doc[copies], d)).astype(np.int64)
    a = np.concatenate((start[copies], a)).astype(np.int32)
    b = np.concatenate((start[copies].astype(np.int64) + span[copies] + (LENGTH - 1), b)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], ["doc_id", "a", "b"])


def _hot_repeats(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, a, b for 25-grams that are too frequent to gather: one row for each string, aggregated by its identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(4))
            span = np.asarray(batch.column(3), np.int64)
            owner = np.repeat(np.arange(len(span)), span)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(span) - span, span)
            p = off[:-1][owner] + inner
            g = grams(data)
            one = mix64(g[p] ^ mix64(g[p + GRAM]))
            two = mix64(g[p + 2 * GRAM] ^ mix64(g[p + 3 * GRAM]))
            doc, start = np.asarray(batch.column(1)), np.asarray(batch.column(2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc[owner]), pa.array((start[owner] + inner).astype(np.int32))], ["f", "g", "doc_id", "a"])

    rows = scratch.save(contexts.mapInArrow(run, "f long, g long, doc_id long, a int"))
    first = scratch.save(rows.groupBy("f", "g").agg(F.min(F.struct("doc_id", "a")).alias("m"), F.count("*").alias("n")).where("n > 1").select("f", "g", F.col("m.doc_id").alias("d0"), F.col("m.a").alias("a0")))
    return rows.join(first, ["f", "g"]).where("doc_id <> d0 or a <> a0").select("doc_id", "a", (F.col("a") + LENGTH).cast("int").alias("b"))


def _applied(texts: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_spans, kept_sha256 of the documents with bytes to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            removed, spans, digests = [], [], []
            for i in range(batch.num_rows):
                text = data[off[i] : off[i + 1]]
                a = np.asarray(batch.column(2)[i].values)
                b = np.asarray(batch.column(3)[i].values)
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
                kept = np.cumsum(depth)[:-1] == 0
                removed.append(len(text) - int(kept.sum()))
                spans.append(int((~kept[1:] & kept[:-1]).sum()) + int(len(kept) > 0 and not kept[0]))
                digests.append(hashlib.sha256(text[kept].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_removed", "n_spans", "kept_sha256"])

    by_doc = removed.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("x")).select(F.col("doc_id").alias("d"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    rows = texts.join(by_doc, F.col("doc_id") == F.col("d")).select("doc_id", "text", "a", "b")
    return rows.mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string")


def repeated_strings(docs: DataFrame, hot: int = HOT_ANCHORS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    A null text counts as empty; texts under 100 bytes lose nothing. Equal texts are one class: all but the one with the
    smallest doc_id are removed whole (100 bytes or more), since each of their strings starts earlier there. A doc_id
    stands for one document: of rows that share one with different texts, the one with the smallest sha256 is judged and
    the others are only compared as whole texts. Rows without a doc_id are only compared as whole texts, too, and come
    after all others. Other columns are not read; an empty table gives an empty result.

    Texts cross the network once, into a table bucketed by doc_id, which the later steps join without another exchange.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce("text", F.lit(""))
    base = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha")))
    classes = base.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.count("doc_id").alias("named"), F.first("n_bytes").alias("n_bytes"))
    classes = scratch.save(classes)
    judged = scratch.save(classes.where(f"rep is not null and n_bytes >= {LENGTH}").groupBy("rep").agg(F.min("sha").alias("sha")))
    size = judged.join(classes.select("sha", "n_bytes"), "sha").agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    buckets = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (32 << 20))))
    name = f"quire_texts_{uuid.uuid4().hex}"
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(judged, F.col("doc_id") == F.col("rep")).where(F.sha2(F.col("text").cast("binary"), 256) == F.col("sha")).select("doc_id", "text").dropDuplicates(["doc_id"])
    whole.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    found = anchors(texts)
    often = scratch.save(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = scratch.save(found.join(often, "h"))
    size = wanted.agg(F.count("*").alias("n"), F.max("n").alias("top")).first()
    partitions = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // PARTITION_ANCHORS)))
    removed = _repeats(_cut(texts, wanted.where(F.col("n") <= hot)), partitions)
    if (size["top"] or 0) > hot:
        removed = removed.unionByName(_hot_repeats(_cut(texts, wanted.where(F.col("n") > hot)), scratch))
    removed = scratch.save(removed)
    result = scratch.save(_applied(texts, removed))
    spark.sql(f"DROP TABLE {name}")
    scratch.drop(often, wanted, removed)
    rep = classes.where("n > 1").select("sha", "rep")
    out = base.join(rep, "sha", "left").withColumn("copy", F.coalesce((F.col("n_bytes") >= LENGTH) & F.col("rep").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("rep")), F.lit(False)))
    out = out.join(result.withColumnRenamed("doc_id", "d").join(judged.withColumnRenamed("sha", "s"), F.col("d") == F.col("rep")).drop("rep"), (F.col("doc_id") == F.col("d")) & (F.col("sha") == F.col("s")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
