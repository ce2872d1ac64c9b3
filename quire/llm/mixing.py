"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get targets by weight, bounded by how often a word may repeat. The mix is a whole number of equal-token blocks,
dealt by highest quotients v / (2 s + 1) (Sainte-Laguë) first to the sources by their targets, then by each source to its
shards by their words. Within a shard, documents lie in a seeded order; their words form one run, cut into blocks, and
the quota takes whole passes over the run and then its first blocks. The plan uses DataFrame functions only; what is
sorted together is one shard of one source, of bounded size.

Seats are exact for any number of them: at the divisor that ends the deal, the rounded shares of n parties sum to the
seats, so that votes / divisor is within n / 2 of the seats in sum. That bounds each party's seats from below and above,
by about 2 n seats in all, and only the quotients between the bounds are ranked.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
REPEATS = 2
BLOCK_WORDS = 16
#: Documents that a shard of a source has on average: what one task sorts.
SHARD_DOCS = 2048
SEED = "mix-1"


def n_words(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> dict[str | None, Fraction]:
    """Target words by source: share of all words by weight, at most repeats times the source's own, the excess reshared by weight."""
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: s.encode()) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    left = share * sum(size.values())
    out: dict[str | None, Fraction] = {}
    open_ = set(order)
    while open_:
        unit = Fraction(left) / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > repeats * size[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(repeats * size[s])
            left -= out[s]
        open_ -= full
    return out


def apportion(votes: list[Fraction], seats: int) -> list[int]:
    """Seats of each party by highest quotients votes / (2 s + 1); the first of equal ones wins."""
    total, n = sum(votes), len(votes)
    if not total:
        return [0] * n
    least = max(Fraction(0), seats - Fraction(n, 2)) / total
    out = [max(0, math.floor(v * least + Fraction(1, 2)) - 1) for v in votes]
    heap = [(-Fraction(v) / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-Fraction(votes[i]) / (2 * out[i] + 1), i))
    return out


def mix(docs: DataFrame, seed: str = SEED, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for each row.

    taken is in words, 0 to repeats times size; a null text has size 0 and takes 0; a null source is a source of its
    own, last in order. Repeated rows are rows of their own: ties in the seeded order of a shard are between rows with
    the same doc_id, and any order of equal rows gives the same multiset. Empty tables give an empty result.

    The source table reaches the driver: one row for each distinct source, whatever the number of documents.
    """
    # the texts are read once, for their word counts
    base = Scratch(docs.sparkSession, "mix").save(docs.select("doc_id", "source", n_words().alias("size")))
    totals = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    if not totals:
        return base.select("doc_id", "size", "source", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    goal = targets([(r["source"], r["size"]) for r in totals], weights, share, repeats)
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    votes = [goal[r["source"]] for r in totals]
    blocks = apportion(votes, math.floor(sum(votes) / block_words + Fraction(1, 2)))
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(r["source"], r["size"], float(v), b, max(1, -(-r["docs"] // shard_docs))) for r, v, b in zip(totals, votes, blocks, strict=True)],
        "p_source string, source_size long, target double, blocks long, shards long",
    )
    # without broadcasts by hint: Spark takes one only if the plan table is under its size limit
    keyed = base.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = keyed.withColumn("rank", key).withColumn("shard", F.conv(F.substring("rank", 1, 8), 16, 10).cast("long") % F.col("shards"))
    quotas = _quotas(keyed, repeats, block_words)
    run = keyed.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    run = run.withColumn("before", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)))
    first = F.col("quota") % F.greatest("words", F.lit(1))
    taken = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.greatest("words", F.lit(1))).cast("long") * F.col("size") + F.least(F.greatest(first - F.coalesce("before", F.lit(0)), F.lit(0)), F.col("size"))).otherwise(0)
    return run.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def _quotas(keyed: DataFrame, repeats: int, block_words: int) -> DataFrame:
    """Words that each shard of each source takes: Sainte-Laguë seats by shard words, at most what the shard can repeat.

    One task ranks about four quotients a shard of a source, that is one for every 512 of its documents.
    """
    shard = keyed.groupBy("source", "shard").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("source_size", "blocks", "shards")])
    share = F.col("words") / F.greatest("source_size", F.lit(1))
    seats = lambda blocks: F.floor(share * blocks + 0.5).cast("long")
    shard = shard.withColumn("low", F.greatest(seats(F.greatest(F.col("blocks") - F.col("shards") / 2, F.lit(0))) - 1, F.lit(0))).withColumn("high", seats(F.col("blocks") + F.col("shards") / 2) + 1)
    given = shard.groupBy("source").agg(F.sum("low").alias("given")).withColumnRenamed("source", "s2")
    quotients = shard.select("source", "shard", "blocks", "words", F.explode(F.sequence("low", "high")).alias("seat")).withColumn("quotient", F.col("words") / (2 * F.col("seat") + 1))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("quotient"), "shard"))
    ranked = quotients.withColumn("place", place).join(given, F.col("source").eqNullSafe(F.col("s2")))
    won = ranked.where(F.col("place") <= F.col("blocks") - F.col("given")).groupBy(F.col("source").alias("s2"), F.col("shard").alias("n2")).agg(F.count("*").alias("won"))
    out = shard.join(won, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("n2")), "left")
    quota = F.least((F.col("low") + F.coalesce("won", F.lit(0))) * block_words, F.col("words") * repeats)
    return out.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "words", quota.alias("quota"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them in whole texts, with all their columns.

    A document stands round(taken / size) times: only the one document at a shard's last block is rounded. Rows with the
    same doc_id share their common quotient. Documents without words, or whose words the mix leaves, go.
    """
    share = mix(docs, **how).groupBy("doc_id").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("_copies")).where("_copies > 0").withColumnRenamed("doc_id", "_id")
    out = docs.join(share, F.col("doc_id").eqNullSafe(F.col("_id")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
