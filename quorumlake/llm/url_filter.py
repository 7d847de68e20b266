"""URL filter by a sort-merge range join on reversed-host keys (DataFrame functions only).

A host's canonical key is its labels in reverse, each followed by a dot:
``blog.example.org`` gives ``org.example.blog.``.  A rule for a host and all its
subdomains is then the interval of keys that start with the rule's key, and the
intervals of any rules are nested or disjoint.  Rules and the distinct hosts of the
urls are range-partitioned by key and swept in order.  The sweep's stack has a slot
for each depth (number of labels) at which rules exist; a rule that
opens replaces its slot, and a slot counts while the swept key is inside its interval.
What is open at the start of a partition is carried in from the partitions before it.
The active rules then go to the urls of each host, where the path decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def filter_urls(urls: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``<id_col>, host, path, rule, verdict`` for every row of ``urls``.

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all subdomains
    when the url's path starts with the rule's; the longest ``host + path`` wins,
    of equally long ones that with the longer host, then the greater rule, then
    ``block`` over ``allow``.  Without a fitting rule, ``rule`` is null and the
    verdict is ``default``.  A null url or one without ``://`` has an empty host and
    path and fits no rule; rules with a null or empty host are ignored, a null path is
    empty, and repeated rules count once.  Repeated ids and urls all come
    back.  Either table may be empty; further columns are ignored.
    """
    spark = urls.sparkSession
    scratch = Scratch(spark)
    u = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u"))
    u = u.select("id", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"))
    r = rules.where("host is not null and host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("host_len"), F.concat("host", "path").alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"), "path",
    )
    opened = r.select(host_key(F.col("host")).alias("key"), rule.alias("r")).groupBy("key").agg(F.collect_list("r").alias("rules"))
    opened = opened.withColumn("depth", F.size(F.split("key", r"\.")) - 1)
    depths = sorted(x.depth for x in opened.select("depth").distinct().collect())  # at most one for each label count, 127 in the DNS

    swept = u.select(host_key(F.col("host")).alias("key"), "host").distinct()
    events = opened.select("key", F.lit(0).alias("kind"), "depth", "rules", F.lit(None).cast("string").alias("host"))
    events = events.unionByName(swept.select("key", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast(opened.schema["rules"].dataType).alias("rules"), "host"))
    events = scratch.save(events.repartitionByRange(partitions(spark), "key").withColumn("range", F.spark_partition_id()), "events")

    slot = lambda d: F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("key", "rules"))
    so_far = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    active = events.select("range", "key", "kind", "host", *(F.last(slot(d), True).over(so_far).alias(f"s{d}") for d in depths)).where("kind = 1")
    if depths:
        ends = events.groupBy("range").agg(*(F.max_by(slot(d), F.when(slot(d).isNotNull(), F.col("key"))).alias(f"e{d}") for d in depths))
        carried = ends.select("range", *(F.last(f"e{d}", True).over(earlier).alias(f"c{d}") for d in depths))
        active = active.join(carried, "range", "left")
    slots = [F.coalesce(f"s{d}", f"c{d}") for d in depths]
    stack = F.flatten(F.array(*(F.when(F.coalesce(F.startswith(F.col("key"), s["key"]), F.lit(False)), s["rules"]).otherwise(F.array()) for s in slots))) if slots else F.lit(None)
    active = active.select("host", stack.alias("stack"))

    out = u.join(active, "host", "left")
    fitting = F.array_max(F.transform(F.filter("stack", lambda x: F.startswith(F.col("path"), x["path"])), lambda x: F.struct(x["len"], x["host_len"], x["rule"], x["verdict"]))) if slots else F.lit(None).cast("struct<len:int,host_len:int,rule:string,verdict:string>")
    out = out.select("id", "host", "path", fitting.alias("best"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table; for short lists."""
    if not rules:
        return spark.sql("select '' host, '' path, '' verdict where false")
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)})" for v, h, p in rules)
    return spark.sql(f"select * from values {rows} as t(host, path, verdict)")
