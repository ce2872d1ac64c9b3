"""Connected components over links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) for every id in links (columns a, b); a component's smallest id has no row.

    Each step sends a vertex's neighbours to the smallest one. All data stay in Spark; every step is written to the
    shared folder, so that lineage does not grow and a lost executor costs one step at most. Smallest ids are taken with
    map-side aggregation, so a hub's links are not gathered in one place.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("w"), F.least("u", "v").alias("m")))
        large = scratch.save(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w"))
        small = large.join(low, F.col("a") == F.col("w")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.save(small.unionByName(low.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct())
        scratch.drop(edges, least, large, low)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
