"""Driver queries for merges, versions and incremental ingestion.

Analogue of arrivals: events by user, ordered by time; purchases are the authoritative source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..streaming import watermarks as wm
from .registry import Tables, query


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _arrivals(spark, sf):
    e = Tables(spark, sf).events
    return e.select("user_id", "event_id", "ts", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"), F.from_json("props", "k long")["k"].alias("k"))


_A = "a AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_id % 3 > 0 THEN value END AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"WITH {_A}, f AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS p FROM a), c AS (SELECT * FROM f WHERE p IS NULL OR event_id <= p OR event_type = 'purchase') SELECT user_id, max_by(value, event_id) FILTER (WHERE value IS NOT NULL) AS value, max_by(event_type, event_id) AS event_type, max_by(k, event_id) AS k FROM c GROUP BY 1")
def precedence_merge(spark, sf):
    return merge.precedence_merge(_arrivals(spark, sf), ["user_id"], "event_id", "event_type", "purchase", ["value"], ["event_type", "k"])


@query(f"WITH {_A} SELECT user_id, arg_max_null(value, event_id) AS value, max_by(event_type, event_id) AS event_type, min_by(k, event_id) AS k FROM a GROUP BY 1")
def latest_wins(spark, sf):
    return merge.latest_wins(_arrivals(spark, sf).drop("ts"), ["user_id"], "event_id", first_only=("k",)).select("user_id", "value", "event_type", "k")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def snapshot_replace(spark, sf):
    li = Tables(spark, sf).lineitem
    cols = ["l_orderkey", "l_linenumber", "l_partkey"]
    return merge.snapshot_replace(li.where("l_returnflag = 'A'").select(cols), li.where("l_returnflag = 'R'").select(cols), ["l_orderkey"])


@query("SELECT user_id, coalesce(max_by(event_id, event_id) FILTER (WHERE event_type = 'click'), min(event_id)) AS name, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def source_priority(spark, sf):
    e = Tables(spark, sf).events.withColumn("name", F.col("event_id"))
    out = merge.source_priority(e, ["user_id"], "event_id", "event_type", "click", "name", "ts")
    return out.select("user_id", "name", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'unchanged' WHEN doc_id % 6 = 5 THEN 'refused' WHEN doc_id % 6 = 0 THEN 'new' WHEN doc_id % 6 = 2 THEN 'touched' ELSE 'changed' END AS change FROM documents")
def change_detect(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", F.col("n_chars").alias("size"), F.lit("Mon").alias("modified"), F.sha2("text", 256).alias("sha"))
    k = F.col("doc_id") % 6
    prior = d.where(k != 0).withColumns({"modified": F.when(k == 1, "Mon").otherwise("Sun"), "sha": F.when(k <= 2, F.col("sha")).otherwise("other")})
    return merge.classify_changes(d, prior, ["doc_id"], "size", "modified", "sha", readable=k != 5).select("doc_id", "change")


@query("WITH v AS (SELECT user_id, event_id, event_type AS sha, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events), r AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS superseded_at FROM v WHERE prev IS NULL OR prev <> sha) SELECT user_id, sha, min(event_id) AS event_id, min(superseded_at) AS superseded_at FROM r WHERE superseded_at IS NOT NULL GROUP BY 1, 2")
def version_history(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_id", F.col("event_type").alias("sha"))
    return merge.version_history(e, ["user_id"], "event_id", "sha").select("user_id", "sha", "event_id", "superseded_at")


@query("SELECT doc_id, lang AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, CAST(quality AS VARCHAR) FROM labels")
def replace_per_key(spark, sf):
    t = Tables(spark, sf)
    return merge.replace_per_key(t.documents.select("doc_id", F.col("lang").alias("value")), t.labels.select("doc_id", F.col("quality").cast("string").alias("value")), "doc_id")


@query("WITH r AS (SELECT DISTINCT l_orderkey AS file_id, l_suppkey AS vorlage FROM lineitem), o AS (SELECT o_orderkey AS file_id, o_custkey % 20 AS vorlage FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT file_id, vorlage, max(own) AS own FROM (SELECT r.file_id, r.vorlage, CASE WHEN o.vorlage IS NOT NULL THEN r.vorlage = o.vorlage ELSE r.vorlage % 2 = 0 END AS own FROM r LEFT JOIN o USING (file_id) UNION ALL SELECT file_id, vorlage, TRUE FROM o) GROUP BY 1, 2")
def override_merge(spark, sf):
    t = Tables(spark, sf)
    r = t.lineitem.select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("vorlage")).distinct().withColumn("own", F.col("vorlage") % 2 == 0)
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 20).alias("vorlage"))
    return merge.override_own(r, o.join(r.select("file_id"), "file_id", "left_semi"), "file_id", "vorlage")


@query("WITH s AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS last_ok FROM events GROUP BY 1) SELECT user_id, CAST(count(*) AS INTEGER) AS attempts, max(event_id) AS last_attempt, count(*) >= 3 AS exhausted FROM events JOIN s USING (user_id) WHERE event_type <> 'purchase' AND (last_ok IS NULL OR event_id > last_ok) GROUP BY 1")
def retry_budget(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return merge.retry_budget(e, ["user_id"], "event_id", "ok")


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'refresh' WHEN l.doc_id IS NOT NULL THEN 'retry' ELSE 'insert' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def seed_merge(spark, sf):
    t = Tables(spark, sf)
    prior = t.labels.select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("missing").alias("text_status"))
    return merge.seed_actions(t.documents.select("doc_id"), prior, ["doc_id"]).select("doc_id", "action")


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'skipped' ELSE 'pending' END AS enrich_status, toxic FROM labels")
def carry_over(spark, sf):
    before = F.when(F.col("quality") == 0, "skipped").when(F.col("toxic") == 0, "ok")
    return Tables(spark, sf).labels.select("doc_id", merge.carried_status(before).alias("enrich_status"), "toxic")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) = 0 ORDER BY d.n_chars DESC NULLS LAST, d.doc_id LIMIT 40")
def work_queue(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left").where("coalesce(quality, 0) = 0")
    return j.orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id")


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%apache%' THEN 'A' WHEN lower(text) LIKE '%mit license%' THEN 'M' ELSE 'none' END AS kind FROM documents")
def recompute(spark, sf):
    from ..functions.text import first_rule

    return Tables(spark, sf).documents.select("doc_id", first_rule(F.col("text"), [("apache", "A"), ("mit license", "M")], "none").alias("kind"))


# ---------------------------------------------------------------- incremental

_CUT = "(SELECT max(ts) - INTERVAL 3 DAY FROM events)"


def _last(spark, sf):
    return Tables(spark, sf).events.agg(F.max("ts").alias("last"))  # one row


@query(f"SELECT event_id FROM events WHERE ts >= {_CUT}")
def incremental_since(spark, sf):
    cut = _last(spark, sf).select((F.col("last") - F.expr("interval 3 days")).alias("cut")).first()["cut"]
    return wm.since(Tables(spark, sf).events, "ts", cut).select("event_id")


@query("SELECT strftime(max(ts) - INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS resume, count(*) FILTER (WHERE ts >= m - INTERVAL 24 HOUR) AS again FROM events, (SELECT max(ts) AS m FROM events)")
def overlap_window(spark, sf):
    e = Tables(spark, sf).events.select("ts").join(F.broadcast(_last(spark, sf)))
    resume = wm.overlapped(F.col("last"))
    return e.agg(F.date_format(F.max(resume), "yyyy-MM-dd HH:mm:ss").alias("resume"), F.count_if(F.col("ts") >= resume).alias("again"))


@query("SELECT strftime(least(TIMESTAMP '2030-01-01' - INTERVAL 24 HOUR, min(ts) FILTER (WHERE event_type = 'error' OR event_id % 1000 = 777)), '%Y-%m-%d %H:%M:%S') AS watermark FROM events")
def holdback(spark, sf):
    e = Tables(spark, sf).events
    out = wm.next_watermark(e, "ts", (F.col("event_type") == "error") | (F.col("event_id") % 1000 == 777), _ts("2030-01-01"), _ts("2000-01-01"))
    return out.select(F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-05-01' - 21 AND DATE '1996-05-01'")
def recheck_window(spark, sf):
    o = Tables(spark, sf).orders.withColumn("d", F.to_date("o_orderdate"))
    return wm.recheck_window(o, "d", F.to_date(F.lit("1996-05-01"))).select("o_orderkey")


@query("SELECT event_id FROM events, (SELECT max(ts) AS m FROM events) WHERE ts <= m - INTERVAL 1 HOUR AND m - INTERVAL 1 HOUR <= ts + INTERVAL 2 HOUR")
def live_now(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "ts").join(F.broadcast(_last(spark, sf)))
    return wm.live_now(e, F.col("ts"), F.col("ts") + F.expr("interval 2 hours"), F.col("last") - F.expr("interval 1 hour")).select("event_id")


@query("WITH v AS (SELECT user_id, event_id, nullif(event_type, 'error') AS sha FROM events), b AS (SELECT *, last_value(sha IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v) SELECT user_id, event_id FROM b WHERE sha IS NULL OR prev IS NULL OR sha <> prev")
def dedupe_latest(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("sha"))
    return wm.first_deliveries(e, ["user_id"], "sha", "event_id").select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'view'")
def tombstone_filter(spark, sf):
    return wm.without_deleted(Tables(spark, sf).events, F.col("event_type") == "view").select("event_id")


@query("SELECT CASE WHEN event_id % 50 = 0 THEN 'broken' ELSE 'ok' END AS kind, count(*) AS n FROM events GROUP BY 1")
def quarantine(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("raw"))
    good, bad = wm.quarantined(e, F.try_parse_json("raw"), ["event_id", "raw"])
    return good.agg(F.lit("ok").alias("kind"), F.count("*").alias("n")).union(bad.agg(F.lit("broken"), F.count("*")))


@query(f"SELECT event_id FROM events WHERE ts >= {_CUT} ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50")
def recent(spark, sf):
    cut = _last(spark, sf).select((F.col("last") - F.expr("interval 3 days")).alias("cut")).first()["cut"]
    return wm.since(Tables(spark, sf).events, "ts", cut).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id")


# ---------------------------------------------------------------- nested objects


@query("SELECT l_orderkey AS meeting_id, 'top' || l_linenumber AS anchor, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2")
def json_explode(spark, sf):
    from ..sources.oparl import agenda_rows

    li = Tables(spark, sf).lineitem
    item = F.struct(F.lit(None).cast("string").alias("id"), F.when(F.col("l_returnflag") != "N", F.concat(F.col("l_linenumber").cast("string"), F.lit("."))).alias("number"), F.lit(" a  b ").alias("name"), F.lit(True).alias("public"))
    m = li.groupBy(F.concat(F.lit("http://h/meetings/"), F.col("l_orderkey").cast("string")).alias("id")).agg(F.collect_list(item).alias("agendaItem"))
    return agenda_rows(m).groupBy(F.col("meeting_id").cast("long").alias("meeting_id"), "anchor").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS meeting_id, l_partkey AS id, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS anchor FROM lineitem GROUP BY 1, 2")
def anchored_wins(spark, sf):
    from ..sources.oparl import FILE, meeting_files

    li = Tables(spark, sf).lineitem
    f = F.struct(F.concat(F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("fileName"), F.lit("x").alias("name"), F.lit("http://h/f").alias("downloadUrl"), F.lit(None).cast("string").alias("accessUrl"), F.lit(False).alias("deleted"))
    none = F.lit(None).cast(FILE)
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_linenumber").cast("string").alias("number"), f.alias("resolutionFile"), F.array().cast(f"array<{FILE}>").alias("auxiliaryFile"))
    under = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", item)))
    m = li.groupBy(F.concat(F.lit("http://h/m/"), F.col("l_orderkey").cast("string")).alias("id")).agg(under.alias("agendaItem"), F.collect_list(F.when(F.col("l_returnflag") != "R", f)).alias("auxiliaryFile"))
    m = m.withColumns({c: none for c in ("invitation", "resultsProtocol", "verbatimProtocol")})
    out = meeting_files(m)
    return out.select(F.col("meeting_id").cast("long").alias("meeting_id"), F.col("id").cast("long").alias("id"), F.replace("agenda_anchor", F.lit("top"), F.lit("")).cast("int").alias("anchor"))


@query("SELECT l_partkey AS paper, l_orderkey AS meeting_id, CASE WHEN l_linenumber <= 3 THEN 'top1' END AS anchor, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def paper_stations(spark, sf):
    from ..sources.oparl import paper_stations as stations

    t = Tables(spark, sf)
    url = lambda kind, c: F.concat(F.lit(f"http://h/{kind}/"), F.col(c).cast("string"))
    item = F.when(F.col("l_linenumber") <= 3, url("items", "l_orderkey")).otherwise(F.lit("http://h/items/other"))
    p = t.lineitem.select(url("papers", "l_partkey").alias("id"), F.lit("2026/0365/3").alias("reference"), F.array(F.struct(url("meetings", "l_orderkey").alias("meeting"), item.alias("agendaItem"))).alias("consultation"))
    agenda = t.orders.select(url("items", "o_orderkey").alias("item"), F.col("o_orderkey").cast("string").alias("meeting_id"), F.lit("top1").alias("anchor"))
    agenda = agenda.union(spark.sql("select 'http://h/items/other', '-1', 'top9'"))
    m = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.to_date("o_orderdate").cast("string").alias("date"))
    return stations(p, agenda, m).select(F.col("paper").cast("long").alias("paper"), F.col("meeting_id").cast("long").alias("meeting_id"), "anchor", "date")
