"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Words are ordered by rarity, and a line's prefix is as many of its rarest words as a
similar line cannot do without. Lines meet on prefix words; a pair goes on if its sizes (length filter), the places of
the common word (positional filter) and the parity of its word hashes (a bound on the symmetric difference) allow the
threshold. The Jaccard similarity of the rest is verified on full sets, and the later line of a pair is removed.

Of two lines, the smaller needs only its first n - ceil(2t / (1 + t) n) + 1 words to meet a larger one on that one's whole
prefix, so the smaller side of the join has little more than half of the prefix words.

Before the join, each line is verified against the first lines of the groups that share two of its four least word
hashes. What that removes cannot be removed again: the join keeps only pairs whose later line is still there, so that a
large group of near copies makes no square of its lines.

Words are 64-bit hashes; in order of rarity the rank stands in place of their top eight bits. Rarity is the count of a word's hash bucket over all texts, on
a scale of 120 steps, in a table of 2**18 bytes: a statistic of fixed size that is part of the plan, so that ordering
words needs no join with a vocabulary. Any order that all lines share gives the same result; rarity only keeps the groups
that meet small.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import JACCARD, Scratch

BUCKET_BITS = 18
#: Passes over the prefix words: each moves this share of them, and their shuffle files go before the next.
PASSES = 2
#: Lines at the front of a key's group that the others are verified against before the join.
HEADS = 8
#: Longs in the filter on documents, at most; with more documents it only lets more of them through.
FILTER_LONGS = 1 << 15
_BLANK = r"[\x20\x09-\x0D]"


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def split_words(text: Column) -> Column:
    """Words and perhaps empty strings; spaces and line feeds part at the least cost, other blanks by pattern."""
    odd = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"))
    return F.when(odd, F.split(text, _BLANK)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))


def word_sets(line: Column) -> Column:
    """The line's distinct word hashes in their own order, and a zero, which parts the two halves of their range."""
    hashes = F.array_remove(F.transform(split_words(line), lambda word: F.xxhash64(word)), F.xxhash64(F.lit("")))
    return F.sort_array(F.array_distinct(F.concat(hashes, F.array(_long(0)))))


def _bucket(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BUCKET_BITS).cast("int")


def rarity_table(docs: DataFrame) -> np.ndarray:
    """For each hash bucket the logarithm of its word count over all texts (1 to 120)."""
    bucket = docs.select(F.explode(split_words(F.col("text"))).alias("w")).select(_bucket(F.xxhash64("w")).alias("b"))
    # eight counts a key: so few keys stay where the map of an aggregation is quickest
    eighth = bucket.select(F.shiftrightunsigned("b", 3).alias("b"), F.col("b").bitwiseAND(F.lit(7)).alias("c"))
    found = eighth.groupBy("b").agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(8)]).toArrow()
    counts = np.zeros((1 << (BUCKET_BITS - 3), 8), np.int64)
    counts[found.column("b").to_numpy()] = np.stack([found.column(f"n{i}").to_numpy() for i in range(8)], axis=1)
    return (1 + np.minimum(119, np.log2(counts.ravel() + 1) * 4)).astype(np.uint8)


def _longs(values: np.ndarray, kind: str) -> Column:
    # one constant array once the plan is folded: an element of it costs less than a character of a string
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def by_rarity(h: Column, table: np.ndarray) -> Column:
    """The words of a set as longs in order of rarity: the bucket's rank in place of the hash's top eight bits, which the bucket gives."""
    top = (table ^ (np.arange(1 << BUCKET_BITS) >> (BUCKET_BITS - 8))).astype(np.uint8).view(np.int8)
    ranks = _longs(top, "tinyint")
    pack = lambda v: v.bitwiseXOR(F.shiftleft(F.get(ranks, F.shiftrightunsigned(v, 64 - BUCKET_BITS)).cast("long"), 56))
    return F.sort_array(F.transform(F.array_remove(h, _long(0)), pack))


def _parity() -> tuple[Column, Column]:
    """128 parity bits of column h in two longs: of the words below zero and of those above, by six bits of the hash."""
    bit = lambda v: F.call_function("shiftleft", _long(1), v.bitwiseAND(F.lit(63)).cast("int"))
    at = F.array_position("h", _long(0)).cast("int")
    halves = F.slice("h", F.lit(1), at - 1), F.slice("h", at + 1, F.size("h"))
    return tuple(F.aggregate(half, _long(0), lambda acc, v: acc.bitwiseXOR(bit(v))) for half in halves)


def _keys() -> tuple[Column, Column]:
    """Two keys of column h, each of two of its words with the least low 56 bits; none under three words, which no other set is similar to."""
    # the zero comes first
    least = F.slice(F.sort_array(F.transform("h", lambda v: v.bitwiseAND(F.lit((1 << 56) - 1)))), 2, 4)
    a, b, c, d = (F.get(F.col("least"), F.lit(i)) for i in range(4))
    return least, F.when(F.col("n") >= 3, F.array(F.xxhash64(a, b), F.xxhash64(c, d))).otherwise(F.array().cast("array<long>"))


def _line_span(every: DataFrame) -> int | None:
    """A number by which a long doc_id * span + line_no orders lines by (doc_id, line_no); None where doc_ids leave no room."""
    r = every.agg(F.max("line_no").alias("lines"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    span = (r["lines"] or 0) + 1
    return span if r["low"] is None or max(abs(r["low"]), abs(r["high"]) + 1) * span < 1 << 62 else None


def _needed(n: str, threshold) -> str:
    """Words of a set of n of which one at least is in every similar set."""
    p, q = threshold
    return f"cast({n} - ceil({n} * {p} / {q}) + 1 as int)"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line: the texts split at line feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _shorter(n: str, threshold) -> str:
    """Words of a set of n of which one at least is in the prefix of every similar set that is not smaller."""
    p, q = threshold
    return f"cast({n} - ceil({n} * {2 * p} / {p + q}) + 1 as int)"


def _alike(na: str, nb: str, a: str, b: str, p: int, q: int) -> str:
    """May sets of these sizes and parity bits reach the threshold p / q?"""
    size = f"least({na}, {nb}) * {q} >= greatest({na}, {nb}) * {p}"
    # the symmetric difference of sets at the threshold is at most (q - p) / (q + p) of the sum of sizes
    apart = f"(bit_count({a}low ^ {b}low) + bit_count({a}high ^ {b}high)) * {p + q} <= ({na} + {nb}) * {q - p}"
    return f"{size} and {apart}"


def _allowed(za: str, zb: str, a: str, b: str, p: int, q: int) -> str:
    """May lines with a common prefix word reach the threshold p / q? z: size in the high half, then the word's place (from 0), then a flag."""
    na, nb = f"shiftright({za}, 32)", f"shiftright({zb}, 32)"
    ia, ib = f"(shiftright({za}, 1) & 2147483647)", f"(shiftright({zb}, 1) & 2147483647)"
    place = f"least({na} - {ia}, {nb} - {ib}) * {p + q} >= ({na} + {nb}) * {p}"
    return f"{place} and {_alike(na, nb, a, b, p, q)}"


def _among(column: str, ids: DataFrame, many: int) -> Column:
    """True where column is in ids, and for some others: a bit of each id's hash in a constant array sized for so many ids."""
    bits = min(FILTER_LONGS.bit_length() - 1, max(6, (many // 8).bit_length()))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    mask = lambda c: F.call_function("shiftleft", _long(1), F.xxhash64(c).bitwiseAND(F.lit(63)).cast("int"))
    found = ids.groupBy(place(F.col(ids.columns[0])).alias("at")).agg(F.bit_or(mask(F.col(ids.columns[0]))).alias("m")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[found.column("at").to_numpy()] = found.column("m").to_numpy()
    return F.get(_longs(table, "bigint"), place(F.col(column))).bitwiseAND(mask(F.col(column))) != 0


def _verified(docs: DataFrame, places, pairs: DataFrame, threshold, scratch: Scratch) -> DataFrame:
    """ib: the later lines of the pairs (ia, ib) whose full sets reach the threshold. places: adds doc_id and line_no to ids."""
    p, q = threshold
    wanted = pairs.select(F.col("ia").alias("id")).unionByName(pairs.select(F.col("ib").alias("id"))).distinct()
    by_doc = places(wanted).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "id"))).alias("ids")).withColumnRenamed("doc_id", "d")
    by_doc = scratch.save(by_doc)
    # most documents have no such line: they are left out before the others meet theirs
    docs = docs.where(_among("doc_id", by_doc.select("d"), by_doc.count()))
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.element_at("ids", i).alias("id"), line.alias("line")))
    again = docs.join(by_doc.hint("shuffle_hash"), F.col("doc_id") == F.col("d")).select(F.inline(F.filter(numbered, lambda s: s["id"].isNotNull())))
    full = scratch.save(again.select("id", word_sets(F.col("line")).alias("h")), hashes=True)
    scratch.settle()
    x = full.select(F.col("id").alias("ia"), F.col("h").alias("x"))
    y = full.select(F.col("id").alias("ib"), F.col("h").alias("y"))
    # common / (x + y - common) >= p / q, with the common words counted once; the zero is in all sets and no word
    common = F.size(F.array_intersect("x", "y")) - 1
    # the sets are what is held: an id has one, however many pairs it is in
    return pairs.join(x.hint("shuffle_hash"), "ia").join(y.hint("shuffle_hash"), "ib").where(common * (p + q) >= p * (F.size("x") + F.size("y") - 2)).select("ib").distinct()


def similar_lines(docs: DataFrame, threshold=JACCARD, scratch: Scratch | None = None) -> DataFrame:
    """All lines that have an equal or similar line before them, as doc_id, line_no."""
    p, q = threshold
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    table = rarity_table(docs)
    sets = lines(docs).select("doc_id", "line_no", word_sets(F.col("line")).alias("h")).withColumn("n", F.size("h") - 1)
    prefix = F.slice(by_rarity(F.col("h"), table), F.lit(1), F.expr(_needed("n", threshold)))
    (low, high), (least, keys) = _parity(), _keys()
    kept = ["doc_id", "line_no", "n", F.xxhash64("h").alias("k"), low.alias("low"), high.alias("high"), prefix.alias("prefix")]
    every = scratch.save(sets.select(*kept, least.alias("least")).withColumn("keys", keys).drop("least"), hashes=True)
    named = every.where("n > 0 and doc_id is not null")
    # equal sets (by 64 bits of hash, 128 of parity and the size): the first line stands for all; ids follow the order of lines
    span = _line_span(every)
    same = ["k", "n", "low", "high"]
    if span:
        # only ids and hashes move to find the first lines; their prefixes follow once it is known which of them go on
        named = named.withColumn("id", F.col("doc_id") * span + F.col("line_no"))
        line_no = F.pmod("id", F.lit(span).cast("long"))
        places = lambda ids: ids.withColumn("line_no", line_no.cast("int")).withColumn("doc_id", F.expr(f"(id - pmod(id, {span}L)) div {span}L"))
        # where rows share a doc_id, an id may have two sets, or one set twice
        lone = every.where("line_no = 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
        by = ["id"] if lone else ["id", "k"]
        two = [F.get(F.col("keys"), F.lit(i)).alias(f"key{i}") for i in range(2)]
        groups = named.select("id", *same, *two).groupBy(*same, "key0", "key1").agg(F.min("id").alias("id"))
        first = scratch.save(groups.withColumn("keys", F.array_compact(F.array("key0", "key1"))).drop("key0", "key1"), hashes=True)
        scratch.settle()
    else:
        first = named.groupBy(*same).agg(F.min(F.struct("doc_id", "line_no", "prefix", "keys")).alias("m")).select("m.*", *same)
        named = first = scratch.save(first.orderBy("doc_id", "line_no").withColumn("id", F.monotonically_increasing_id()), hashes=True)
        places = lambda ids: first.select("id", "doc_id", "line_no").join(ids, "id", "left_semi")
        by, lone = ["id"], True
        equal = scratch.save(every.where("n > 0 and doc_id is not null").select("doc_id", "line_no").join(first.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti"))
        scratch.drop(every)
        scratch.settle()
    # each line against the first lines of the groups of its keys; most keys have one line and end here
    keyed = first.select("id", "n", "low", "high", F.explode("keys").alias("key"))
    in_group = Window.partitionBy("key").orderBy("id")
    ranked = keyed.withColumn("r", F.row_number().over(in_group)).withColumn("next", F.lead("id").over(in_group))
    shared = scratch.save(ranked.where("r > 1 or next is not null").drop("next"), hashes=True)
    heads = shared.where(F.col("r") <= HEADS).select("key", F.col("id").alias("ia"), *[F.col(c).alias("a_" + c) for c in ("n", "low", "high")])
    led = shared.join(heads, "key").where(F.expr(f"ia < id and {_alike('a_n', 'n', 'a_', '', p, q)}"))
    pairs = scratch.save(led.select("ia", F.col("id").alias("ib")).distinct())
    scratch.drop(shared)
    done = scratch.save(_verified(docs, places, pairs, threshold, scratch))
    # all other pairs: the smaller line's shorter prefix meets the larger one's whole prefix
    state = first.select(*by).join(done.withColumnRenamed("ib", "id").withColumn("gone", F.lit(1)), "id", "left").select(*by, F.col("gone").isNull().cast("int").alias("open"))
    # lines that are not the first of their set have no state
    stated = named.select(*dict.fromkeys([*by, "n", "low", "high", "prefix"])).join(state, by, "left")
    stated = scratch.save(stated.select("id", "n", "low", "high", F.when(F.col("open").isNotNull(), F.col("prefix")).alias("prefix"), "open"), hashes=True)
    marked = stated.where("open is not null")
    marked = marked if lone else scratch.save(marked.dropDuplicates(["id", "prefix"]), hashes=True)
    if span:
        equal = stated.where("open is null").select("id")
        equal = places(equal if lone else equal.join(first.select("id"), "id", "left_anti")).select("doc_id", "line_no")
        scratch.drop(every, *[first] * lone)
    scratch.settle()

    def share(size: str, k: int) -> DataFrame:
        words = marked.select("id", "n", "low", "high", "open", F.posexplode(F.expr(f"slice(prefix, 1, {size})")).alias("i", "w")).where(F.pmod("w", F.lit(PASSES)) == k)
        return words.select("w", "id", F.expr("shiftleft(cast(n as long), 32) | shiftleft(cast(i as long), 1) | open").alias("z"), "low", "high")

    parts = []
    ordered = "(shiftright(a.z, 32) < shiftright(b.z, 32) or shiftright(a.z, 32) = shiftright(b.z, 32) and a.id < b.id)"
    later_open = "(case when a.id < b.id then b.z else a.z end) & 1 = 1"
    for k in range(PASSES):
        a, b = share(_shorter("n", threshold), k).alias("a"), share("n", k).alias("b")
        met = a.join(b, F.expr(f"a.w = b.w and {ordered} and {later_open} and {_allowed('a.z', 'b.z', 'a.', 'b.', p, q)}"))
        parts.append(scratch.save(met.select(F.expr("least(a.id, b.id)").alias("ia"), F.expr("greatest(a.id, b.id)").alias("ib")).distinct()))
        scratch.settle()
    more = reduce(DataFrame.unionByName, parts).distinct()
    found = scratch.save(done.unionByName(_verified(docs, places, more.join(pairs, ["ia", "ib"], "left_anti"), threshold, scratch)))
    near = places(found.select(F.col("ib").alias("id")).distinct()).select("doc_id", "line_no")
    # what is similar to the first of equal lines removes that one; its copies are removed already
    return equal.unionByName(near).distinct()


def deduplicate_lines(docs: DataFrame, threshold=JACCARD) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0) for each row.

    A line is removed if a line before it (smaller doc_id, or the same and a smaller number) has a word set with Jaccard
    similarity of 0.75 or more; lines are judged on the input, not on what is left. Words are what blanks part, as they
    are written. Lines without words stay; a null text has no lines; rows that share a doc_id are one document, whose
    rows all get its line numbers; rows without a doc_id match nothing. Other columns are not read; an empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    removed = similar_lines(docs, threshold, scratch)
    by_doc = removed.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed")).withColumnRenamed("doc_id", "d")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = base.join(by_doc, F.col("doc_id") == F.col("d"), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the texts of deduplicate_lines' result: removed lines are left out, all other columns stay."""
    by_doc = found.where("n_removed > 0").select(F.col("doc_id").alias("_d"), F.col("removed").alias("_removed")).dropDuplicates(["_d"])
    joined = docs.join(by_doc, F.col("doc_id").cast("long") == F.col("_d"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_removed", i)), "\n")
    return joined.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)).drop("_d", "_removed")
