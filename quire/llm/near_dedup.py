"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct 5-word shingles. Equal sets are one class. A class has a signature of 36 b-bit
values (b = 32), split into 12 chunks of 3. Two signatures that differ in at most 23 places agree in at least two places
of some chunk (pigeonhole), so indexing each chunk under its three ways to leave one place out finds all such pairs;
at Jaccard similarity 0.75 a pair differs in more places with a probability of about 1e-7. Candidates are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import JACCARD, SHINGLE_WORDS, Scratch, mix64, row_pieces, shingle_set, shingles, spread, words
from quire.llm.components import components

CHUNKS = 12
PLACES = 3
#: Signatures that differ in more places than this are not candidates; up to it none is missed.
RADIUS = CHUNKS * 2 - 1

#: Shingles of texts that a worker keeps while it confirms pairs.
CACHE_SHINGLES = 4_000_000

_SEEDS = spread(CHUNKS * PLACES, 31)
_PAIRS = ((0, 1), (0, 2), (1, 2))
_U = np.uint64


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the set, and the signature as an array of ints (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in row_pieces(batch, "text"):
                h, _, _, first = words(data, off)
                s, at = shingles(h, first, width)
                n = part.num_rows
                size = np.zeros(n, np.int64)
                sets = []
                for i in np.flatnonzero(np.diff(at)):
                    own = np.unique(s[at[i] : at[i + 1]])
                    size[i] = len(own)
                    sets.append(own)
                full = size > 0
                one = np.zeros(n, np.uint64)
                two = np.zeros(n, np.uint64)
                sig = np.zeros((n, CHUNKS * PLACES), np.int32)
                if sets:
                    flat = np.concatenate(sets)
                    starts = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    one[full] = np.add.reduceat(mix64(flat), starts)
                    two[full] = np.add.reduceat(mix64(flat ^ _U(0x5851F42D4C957F2D)), starts)
                    for k, seed in enumerate(_SEEDS):
                        x = flat * seed
                        x ^= x >> _U(29)
                        x *= seed
                        sig[full, k] = (np.minimum.reduceat(x, starts) >> _U(32)).astype(np.uint32).view(np.int32)
                width_ = CHUNKS * PLACES
                offsets = np.concatenate(([0], np.cumsum(np.where(full, width_, 0)))).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), arrays], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>")


def index_rows(sigs: DataFrame) -> DataFrame:
    """key, id: each signature under every chunk with each allowed error left out."""
    keys = [F.xxhash64(F.lit(c * 3 + e), F.col("sig")[c * PLACES + i], F.col("sig")[c * PLACES + j]) for c in range(CHUNKS) for e, (i, j) in enumerate(_PAIRS)]
    return sigs.select(F.explode(F.array(*keys)).alias("key"), F.col("doc_id").alias("id"))


def differing(a: str, b: str):
    """In how many places two signatures differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z))


def near(pairs: DataFrame, sigs: DataFrame, threshold=JACCARD) -> DataFrame:
    """The pairs (a, b) within the signature radius whose set sizes allow the threshold."""
    p, q = threshold
    left = sigs.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    fits = (F.least("na", "nb") * q >= F.greatest("na", "nb") * p) & (differing("sa", "sb") <= RADIUS)
    return both.where(fits).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE_WORDS, threshold=JACCARD) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. texts: id, text of all ids in pairs."""
    p, q = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def of(key: int, text) -> np.ndarray:
            nonlocal held
            if (got := sets.get(key)) is None:
                if held > CACHE_SHINGLES:
                    sets.clear()
                    held = 0
                got = sets[key] = shingle_set((text.as_py() or "").encode(), width)
                held += len(got)
            return got

        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ids = list(zip(a.to_pylist(), b.to_pylist(), strict=True))
            keep = np.zeros(batch.num_rows, bool)
            for i, (j, k) in enumerate(ids):
                one, two = of(j, batch.column(2)[i]), of(k, batch.column(3)[i])
                if len(one) > len(two):
                    one, two = two, one
                at = np.searchsorted(two, one)
                common = int((two[np.minimum(at, len(two) - 1)] == one).sum()) if len(one) else 0
                keep[i] = common and q * common >= p * (len(one) + len(two) - common)
            m = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(m), b.filter(m)], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, threshold=JACCARD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    component_id is the smallest doc_id reachable over links, the row's own included. A null text, or one without words,
    has no shingles, links with nothing and is kept; fewer than five words are one shingle. Rows with the same doc_id
    are one vertex with the links of all of them; rows without a doc_id link with nothing, have a null component and
    are kept. Other columns are not read. An empty table gives an empty result.

    Within an index key, members are first compared with the key's smallest id only. What stays apart after that is
    compared further, across components, until no candidate pair of two components is left untested: no link between
    components is lost, and a large group of near copies costs a number of pairs in proportion to its size.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sigs = scratch.save(signatures(docs, width))
    split = scratch.save(sigs.where("doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("doc_id"))
    if split.isEmpty():
        return _near_duplicates(docs, sigs, width, threshold, scratch)
    # ids with several texts: each text is a vertex of its own, and those of an id are joined afterwards
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), "text").join(split.select(F.col("doc_id").alias("own"), F.lit(True).alias("several")), "own", "left")
    rows = scratch.save(rows.select(F.when(F.col("several"), F.xxhash64("own", "text")).otherwise(F.col("own")).alias("doc_id"), "own", "text"))
    found = _near_duplicates(rows, scratch.save(signatures(rows, width)), width, threshold, scratch)
    owner = rows.where("own is not null").select("doc_id", "own").distinct()
    found = scratch.save(found.join(owner, "doc_id", "left").select("own", "n_shingles", F.col("component_id").alias("c")))
    several = found.join(split.select(F.col("doc_id").alias("own")), "own", "left_semi")
    joined = components(scratch.save(several.join(several.groupBy("own").agg(F.min("c").alias("a")), "own").where("a <> c").select("a", F.col("c").alias("b")).distinct()), scratch)
    found = scratch.save(found.join(joined, F.col("c") == F.col("id"), "left").select("own", "n_shingles", F.coalesce("component", "c").alias("c")))
    least = found.where("c is not null").groupBy("c").agg(F.min("own").alias("component_id"))
    return found.join(least, "c", "left").select(F.col("own").alias("doc_id"), "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("own") == F.col("component_id"))).alias("kept"))


def _near_duplicates(docs: DataFrame, sigs: DataFrame, width: int, threshold, scratch: Scratch) -> DataFrame:
    """near_duplicates of docs where all rows of an id have the same text. sigs: their signatures."""
    filled = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    own = scratch.save(filled.join(classes.where("n > 1").select("n_shingles", "d1", "d2"), ["n_shingles", "d1", "d2"], "left_anti").select("doc_id", "n_shingles", "sig").unionByName(filled.join(classes.where("n > 1").select(F.col("rep").alias("doc_id"), "n_shingles", "d1", "d2"), ["doc_id", "n_shingles", "d1", "d2"], "left_semi").select("doc_id", "n_shingles", "sig")).dropDuplicates(["doc_id"]))
    keyed = index_rows(own)
    heads = scratch.save(keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("key", "head"))
    # only rows under a key that someone shares go further
    shared = scratch.save(keyed.join(heads, "key"))
    pairs = scratch.save(near(shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), own, threshold))
    ids = shared.select("id").distinct()
    texts = scratch.save(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi").dropDuplicates(["id"]))
    links = scratch.save(confirmed(pairs, texts, width, threshold))
    found = components(links, scratch)
    more = untested(shared, found, pairs, own, texts, width, threshold, scratch)
    if not more.isEmpty():
        links = scratch.save(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(confirmed(more, texts, width, threshold)))
        found = components(links, scratch)
    rep = classes.where("n > 1").drop("n")
    out = sigs.drop("sig").join(rep, ["n_shingles", "d1", "d2"], "left").withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(found, F.col("rep") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """id, n and one distinct shingle of each text in every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            for i, text in enumerate(batch.column(1)):
                own = shingle_set((text.as_py() or "").encode(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), ids[i])), pa.array(np.full(len(own), len(own))), pa.array(own)], ["id", "n", "s"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, s long")


def untested(shared: DataFrame, found: DataFrame, tested: DataFrame, own: DataFrame, texts: DataFrame, width: int, threshold, scratch: Scratch) -> DataFrame:
    """All pairs of two components that share an index key, can reach the threshold and were not tested.

    The pairs are not listed key by key, which would grow with the square of a common passage's documents. A text whose
    shingles occur elsewhere among these texts to less than the threshold cannot link and leaves. The rest are joined
    on their rarest shingles, as many as a pair at the threshold cannot do without, and then held to the signature radius.
    """
    p, q = threshold
    owner = shared.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = owner.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    left = scratch.save(shared.select("key", "id").join(mixed, "key", "left_semi").select("id").distinct())
    rows = scratch.save(shingle_rows(texts.join(left, "id", "left_semi"), width))
    for _ in range(2):
        lone = rows.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").groupBy("id").agg(F.count("*").alias("lone"))
        size = rows.select("id", "n").distinct()
        alive = size.join(lone, "id", "left").where(f"(n - coalesce(lone, 0)) * {q} >= n * {p}").select("id")
        kept = scratch.save(rows.join(alive, "id", "left_semi"))
        scratch.drop(rows)
        rows = kept
    often = rows.groupBy("s").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "s"))
    prefix = scratch.save(rows.join(often.where("f > 1"), "s", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("place", place).where(f"place <= n - ceil(n * {p} / {q}) + 1 and f > 1").select("id", "n", "s", "place").join(found, "id", "left").select("id", "n", "s", "place", F.coalesce("component", "id").alias("c")))
    a = prefix.select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("c").alias("ca"))
    b = prefix.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("c").alias("cb"))
    # what can still be common from the first common shingle on must reach the overlap that the threshold asks for
    reach = f"(1 + least(na - pa, nb - pb)) * {p + q} >= (na + nb) * {p}"
    pairs = a.join(b, "s").where(f"a < b and ca <> cb and least(na, nb) * {q} >= greatest(na, nb) * {p} and {reach}").select("a", "b").distinct()
    more = scratch.save(near(pairs.join(tested, ["a", "b"], "left_anti"), own, threshold))
    scratch.drop(rows, prefix)
    return more


def deduplicated(docs: DataFrame, width: int = SHINGLE_WORDS, threshold=JACCARD) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    gone = near_duplicates(docs, width, threshold).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
