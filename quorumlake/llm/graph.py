"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``: the smallest id that
    links reach.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), whose
    rounds grow with the logarithm of the longest chain.  Every round is written
    to the shared folder.  Both steps are an aggregation with map-side combine
    and an equi-join that adaptive execution can split, so one node with very
    many edges doesn't sit in one task.  Null ends are ignored; an empty table
    gives an empty table.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b")
    e = scratch.save(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    before = None
    for i in range(1, rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours larger than a point at the least of a's neighbourhood
        large = e.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a's smaller neighbours, and a, point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        nxt = scratch.save(small.where("a <> b").distinct(), f"{tag}-{i}")
        scratch.drop(f"{tag}-{i - 1}")
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        e = nxt
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
