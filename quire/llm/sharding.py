"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a 60-bit hash of the key. A bucket that is over the byte limit splits on
its next bit, and only such buckets split; a bucket within the limit is a shard. Sums by prefix are made once at a fine
depth with map-side aggregation and rolled up from there; a document's shard is the shallowest prefix that fits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch

BITS = 60
SHARD_BYTES = 16 << 20
#: Depth beyond the average one at which prefixes are first summed.
SLACK_BITS = 6


def hash_bits(key):
    """The first 60 bits of md5 of the key as text; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int, depth: int) -> DataFrame:
    """cell (prefix at depth), bits, prefix, shard_bytes: the shallowest prefix of each cell that is within the limit.

    Cells that are over the limit even at depth have bits null.
    """
    cells = sizes.groupBy(F.shiftright("h", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("b"))
    level = cells.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - bits)"))
    fits = level.groupBy("bits", "prefix").agg(F.sum("b").alias("shard_bytes"), F.min("cell").alias("low"), F.max("cell").alias("high")).where(F.col("shard_bytes") <= limit)
    pair = level.join(fits.select("bits", "prefix", "shard_bytes"), ["bits", "prefix"], "left_outer")
    best = pair.groupBy("cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("bits", "prefix", "shard_bytes"))).alias("m"))
    return best.select("cell", "m.bits", "m.prefix", "m.shard_bytes")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default doc_id), n_bytes, shard_id, shard_bits, shard_bytes, fits.

    shard_id is the directory prefix as a string of shard_bits bits (empty where all rows fit one shard). Rows with the
    same doc_id share all bits. Where 60 bits cannot part an oversized bucket, its rows go to shards of their own by a
    running sum of bytes; a single row over the limit stands alone in a shard with fits false. A null text has 0 bytes;
    a null doc_id counts as an empty one; an empty table gives an empty result; clashing columns are not read.
    """
    keep = keep or ["doc_id"]
    scratch = Scratch(docs.sparkSession, "shard")
    # the texts are read once, for their lengths; all later steps read this narrow table
    sizes = scratch.save(docs.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col("doc_id")).alias("h")))
    total = sizes.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    cells = scratch.save(directory(sizes, limit, depth))
    found = sizes.withColumn("cell", F.shiftright("h", BITS - depth)).join(cells, "cell", "left")
    part = _labelled(found.where("bits is not null"), keep, F.lpad(F.when(F.col("bits") > 0, F.bin("prefix")).otherwise(""), F.col("bits"), F.lit("0")), F.lit(True))
    if cells.where("bits is null").isEmpty():
        return part
    open_ = found.where("bits is null").select(*keep, "n_bytes", "h")
    # deeper levels exist only for cells that one key or a few large rows overfill
    deep = directory(open_, limit, BITS)
    deeper = open_.withColumnRenamed("h", "cell").join(deep, "cell", "left")
    rest = _labelled(deeper.where("bits is not null"), keep, F.lpad(F.bin("prefix"), F.col("bits"), F.lit("0")), F.lit(True))
    alone = deeper.where("bits is null")
    run = F.sum("n_bytes").over(Window.partitionBy("cell").orderBy("n_bytes", *[F.col(c).cast("string") for c in keep]).rowsBetween(Window.unboundedPreceding, -1))
    # bins by running sum: half of the limit, so that a bin with its last row stays within it if the row does
    big = F.col("n_bytes") > limit // 2
    n = F.row_number().over(Window.partitionBy("cell", big).orderBy("n_bytes", *[F.col(c).cast("string") for c in keep]))
    bin_ = F.when(big, F.concat(F.lit("-r"), n.cast("string"))).otherwise(F.concat(F.lit("-b"), F.floor(F.coalesce(run, F.lit(0)) / (limit // 2)).cast("string")))
    alone = alone.withColumn("label", F.concat(F.lpad(F.bin("cell"), BITS, "0"), bin_)).withColumn("bits", F.lit(BITS))
    sums = alone.groupBy("label").agg(F.sum("n_bytes").alias("label_bytes"))
    alone = alone.drop("shard_bytes").join(sums.withColumnRenamed("label", "l2"), F.col("label") == F.col("l2")).withColumnRenamed("label_bytes", "shard_bytes")
    return part.unionByName(rest).unionByName(_labelled(alone, keep, F.col("label"), F.col("shard_bytes") <= limit))


def _labelled(df: DataFrame, keep: list[str], label, fits) -> DataFrame:
    return df.select(*keep, "n_bytes", label.alias("shard_id"), F.col("bits").cast("int").alias("shard_bits"), F.col("shard_bytes").cast("long").alias("shard_bytes"), fits.alias("fits"))
