"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document draws the exponential key ``-ln(u) / w``: u follows from its id and a seed,
w is its quality weight.  Ascending keys order a weighted sample
without replacement.  A source's target is met by complete epochs first, then by
the documents whose prefix sum of sizes in key order stays within what is left.

Prefix sums never put a source in one task: keys fall into ``BUCKETS`` ordered
buckets, whose sums are prefix-summed; a bucket wholly before the limit is taken, one
wholly after it is not, and only the one that holds the limit is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

BUCKETS = 4096
#: Rows of limits (``BUCKETS`` a source) that are broadcast; more are joined by shuffling.
BROADCAST = 200_000
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, id_: Column) -> Column:
    """Between 0 and 1, both excluded, from the md5 of seed and id: 13 hexadecimal digits."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def source_targets(sizes: DataFrame, *, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row for each source.

    Sources in code point order, null last, have the weights in turn and share
    ``share`` (a fraction) of all sizes; a target stops at ``most`` times its source's size and
    the excess is shared again by weight.  That ends where targets are
    ``min(most * size, level * weight)``: sources in order of ``size / weight`` are capped as long as
    their cap is at most what the sources not yet capped would get.  Integers decide this.
    The windows see one row for each source.
    """
    up, down = share
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    s = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), w.alias("w"))
    by_level = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before, rest, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    s = s.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(every) * up).alias("budget"),  # times ``down``
        (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most * down).alias("capped"),
        F.sum("w").over(rest).alias("w_left"),
    )
    s = s.withColumn("cap", F.col("source_size") * (most * down) * F.col("w_left") <= (F.col("budget") - F.col("capped")) * F.col("w"))
    # the first source that isn't capped sets the level
    level = F.min_by(F.struct((F.col("budget") - F.col("capped")).alias("left"), "w_left"), F.when(~F.col("cap"), F.col("source_size") / F.col("w"))).over(every)
    target = F.when(F.col("cap"), (F.col("source_size") * most).cast("double")).otherwise(level["left"] * F.col("w") / (level["w_left"] * down))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs``.

    ``weights`` (``doc_id, w``) holds quality weights over 0; without a row, with a null or with one not over 0
    it is 1, of several the greatest counts.  ``copies`` is how often the mix takes
    the document, ``taken`` that many times its size in words.  A null text has size 0; a document without
    words is taken as often as its source has complete epochs.
    A null source is a source.  The document on the limit is taken if that brings the
    source nearer its target.  Equal keys are ordered by id, then size; repeated
    rows are sampled one by one.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    d = scratch.save(_drawn(docs, weights, id_col, text_col, source_col, seed), "sizes")
    d = _taken(d, _limits(d, scratch), [])
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix_sources`` takes it.

    Every row is decided by itself, those with equal or null ids included, and carries its columns
    along: texts are joined with nothing but the weights.  Rows equal in key, id and size are
    ordered by the hash of their text.  An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    limits = _limits(scratch.save(_drawn(docs, weights, id_col, text_col, source_col, seed).select("source", "bucket", "size"), "sizes"), scratch)
    d = _drawn(docs, weights, id_col, text_col, source_col, seed, F.struct(*docs.columns).alias("row"))
    d = _taken(d, limits, [F.xxhash64(F.col(f"row.{text_col}"))])
    return d.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def _drawn(docs: DataFrame, weights: DataFrame | None, id_col: str, text_col: str, source_col: str, seed: str, *kept: Column) -> DataFrame:
    """``doc_id, source, size, key, bucket`` and what is kept."""
    # rows without an id get numbers of their own, so that they meet neither a weight nor each other in one task
    spread = F.when(F.col(id_col).isNull(), 1 + F.pmod(F.xxhash64(text_col), F.lit(4096))).otherwise(0)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), spread.cast("long").alias("spread"), *kept)
    w = F.lit(1.0)
    if weights is not None:
        of_id = weights.where("doc_id is not null").groupBy(F.col("doc_id").alias("weighed")).agg(F.max("w").cast("double").alias("w"))
        of_id = of_id.withColumn("weighed_spread", F.lit(0).cast("long"))
        d = d.withColumn("met", F.coalesce("doc_id", F.lit(0).cast("long")))
        d = d.hint("merge").join(of_id, (F.col("met") == F.col("weighed")) & (F.col("spread") == F.col("weighed_spread")), "left").drop("met", "weighed", "weighed_spread")
        w = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    d = d.withColumn("key", -F.log(uniform(seed, F.col("doc_id"))) / w).drop("w", "spread")
    return d.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))


def _limits(d: DataFrame, scratch: Scratch) -> DataFrame:
    """Targets of each source and what they mean for each of its buckets: wholly taken, wholly not, or null."""
    sums = scratch.save(d.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(run)).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    limits = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target", "epochs", "left",
        (F.col("upto") - F.col("n")).alias("base"),
        F.when((F.col("left") > 0) & (F.col("upto") <= F.col("left")), 1).when((F.col("left") <= 0) | (F.col("upto") - F.col("n") >= F.col("left")), 0).alias("whole"),
    )
    limits = scratch.save(limits, "limits")
    return F.broadcast(limits) if limits.count() <= BROADCAST else limits


def _taken(d: DataFrame, limits: DataFrame, ties: list[Column]) -> DataFrame:
    """Rows of ``d`` with their source's size and target and their ``copies``."""
    d = d.join(limits, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inner = d.where("whole is null")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("before", F.col("base") + F.sum("size").over(order) - F.col("size"))
    inner = inner.withColumn("part", (2 * F.col("before") + F.col("size") <= 2 * F.col("left")).cast("long")).drop("before")
    outer = d.where("whole is not null").withColumn("part", F.col("whole").cast("long"))
    return outer.unionByName(inner).withColumn("copies", F.col("epochs") + F.col("part"))
