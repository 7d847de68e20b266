"""Driver queries for filters, joins, aggregates, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import contains_ascii_ci, int_prefix
from ..operators import facets as fc
from ..operators import records as rec
from .registry import Tables, query


# ---------------------------------------------------------------- filters


@query("SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND d.n_chars >= 500 AND l.quality = 1")
def facet_filter(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return fc.facet_filter(d, fc.equal(F.col("lang"), "en"), fc.equal(F.col("source"), None), F.col("n_chars") >= 500, fc.flag(F.col("quality") == 1, True)).drop("n_chars")


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_name = '7' OR c.c_nationkey = 7")
def filter_name_or_id(spark, sf):
    t = Tables(spark, sf)
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return fc.facet_filter(j, fc.name_or_id(F.col("n_name"), F.col("c_nationkey").cast("string"), "7")).select("c_custkey", "n_name")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-31'")
def date_range(spark, sf):
    o = Tables(spark, sf).orders
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1995-03-31"))
    return fc.facet_filter(o, F.col("o_orderdate") >= lo, F.col("o_orderdate") <= hi).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def public_filter(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("toxic")), "doc_id", "left")
    return fc.facet_filter(d, fc.flag(F.col("toxic"), False)).select("doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE list_contains([CAST(json_extract(props, '$.k') AS BIGINT), 0], 7)")
def json_array_contains(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return fc.facet_filter(e, fc.has_tag(F.array("k", F.lit(0).cast("long")), 7))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%an%' OR lower(p_brand) LIKE '%an%' OR lower(coalesce(p_type, '')) LIKE '%an%'")
def multi_col_like(spark, sf):
    p = Tables(spark, sf).part
    return fc.facet_filter(p, fc.any_contains([F.col("p_name"), F.col("p_brand"), F.col("p_type")], "AN")).select("p_partkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
def exists_array(spark, sf):
    li = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))
    return li.where(F.exists("items", lambda x: (x["l_quantity"] >= 49) & (x["l_returnflag"] == "R"))).select("l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def in_semi(spark, sf):
    t = Tables(spark, sf)
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_in_anti(spark, sf):
    t = Tables(spark, sf)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang <> '' AND text IS NOT NULL AND text <> ''")
def null_blank(spark, sf):
    filled = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("lang", "text")]
    return fc.facet_filter(Tables(spark, sf).documents, *filled).agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE lower(url) LIKE 'https%'")
def url_prefix(spark, sf):
    from ..functions.text import like_ascii_ci

    return Tables(spark, sf).pages.where(like_ascii_ci(F.col("url"), "HTTPS%")).select("page_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE source = 'src3'")
def drop_heavy(spark, sf):
    return Tables(spark, sf).documents.where("source = 'src3'").drop("text")


@query("SELECT doc_id, substr(text, 1, 800) AS head, length(substr(text, 1, 8000)) AS served FROM documents WHERE n_chars > 5000")
def truncate_text(spark, sf):
    from ..functions.text import capped

    d = Tables(spark, sf).documents.where("n_chars > 5000")
    return d.select("doc_id", capped(F.col("text"), "head").alias("head"), F.length(capped(F.col("text"), "served")).cast("long").alias("served"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42 LIMIT 1")
def point_lookup(spark, sf):
    return Tables(spark, sf).orders.where("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_orderstatus").limit(1)


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_linenumber <> 1) AS mentions FROM lineitem GROUP BY l_orderkey")
def array_filter(spark, sf):
    a = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linenumber")).alias("x"))
    return a.select("l_orderkey", F.size(F.filter("x", lambda v: (v["l_returnflag"] != "N") & (v["l_linenumber"] != 1))).cast("long").alias("mentions"))


# ---------------------------------------------------------------- joins


@query("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'")
def left_join(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return t.orders.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT l.l_partkey, l.l_suppkey, l.l_orderkey, a.n FROM lineitem l LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) a USING (l_partkey, l_suppkey)")
def left_join_composite(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag")
    a = li.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return li.join(a, ["l_partkey", "l_suppkey"], "left").select("l_partkey", "l_suppkey", "l_orderkey", "n")


@query("SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
def inner_join(spark, sf):
    t = Tables(spark, sf)
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT r_name, count(*) AS items, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def star_join(spark, sf):
    t = Tables(spark, sf)
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("items"))  # before any join: a row for each order
    j = per_order.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("items").alias("items"), F.count("*").alias("orders"))


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS meetings, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS documents FROM nation")
def committee_counts(spark, sf):
    t = Tables(spark, sf)
    n = rec.with_count(t.nation.select("n_nationkey", "n_name"), "n_nationkey", t.customer, "c_nationkey", "members")
    n = rec.with_count(n, "n_nationkey", t.supplier, "s_nationkey", "meetings")
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("k")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = per.groupBy("c_nationkey").agg(F.sum("k").alias("documents"))
    return n.join(per, n["n_nationkey"] == per["c_nationkey"], "left").drop("c_nationkey").withColumn("documents", F.coalesce("documents", F.lit(0)))


@query("SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE props IS NOT NULL AND props <> '{}'")
def lateral_json(spark, sf):
    e = Tables(spark, sf).events.where("props is not null and props <> '{}'")
    return e.select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value")).where("key = 'k'").select("value").distinct()


@query("""
WITH m AS (SELECT s_nationkey AS body, s_suppkey % 7 AS sn, n_regionkey AS party FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT c_custkey, c_nationkey AS body, c_custkey % 7 AS sn FROM customer),
own AS (SELECT body, sn, min(party) AS lo, max(party) AS hi FROM m GROUP BY 1, 2), every AS (SELECT sn, min(party) AS lo, max(party) AS hi FROM m GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(o.lo, v.lo) = coalesce(o.hi, v.hi) THEN coalesce(o.lo, v.lo) END AS party FROM e LEFT JOIN own o ON o.body = e.body AND o.sn = e.sn LEFT JOIN every v ON v.sn = e.sn
""")
def resolve_with_fallback(spark, sf):
    from ..operators.rollcall import attribute

    t = Tables(spark, sf)
    name = lambda k: F.concat(F.lit("Name"), (F.col(k) % 7).cast("string"))
    m = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("body_id"), name("s_suppkey").alias("name"), F.col("n_regionkey").cast("string").alias("party_code"))
    e = t.customer.select("c_custkey", F.col("c_nationkey").alias("body_id"), name("c_custkey").alias("name"))
    return attribute(e, m).select("c_custkey", F.col("party").cast("int").alias("party"))


@query("SELECT c.c_custkey, n.n_nationkey AS body_id FROM (SELECT c_custkey, 'NATION_' || c_nationkey AS name FROM customer) c LEFT JOIN nation n ON n.n_name = c.name")
def name_lookup(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name"))
    return c.join(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("body_id")), "name", "left").select("c_custkey", "body_id")


@query("SELECT o_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey")
def nested_detail(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag").join(o, "o_orderkey", "left_semi")
    g = li.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return g.select("o_orderkey", F.array_join(F.transform("x", lambda v: F.concat(v["l_linenumber"].cast("string"), F.lit(":"), v["l_returnflag"])), ",").alias("items"))


@query("""
WITH live AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS body FROM orders),
tk AS (SELECT o_orderkey AS ticker, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS committee FROM orders),
j AS (SELECT ticker, count(*) AS n, min(id) AS only_one, min(CASE WHEN starts_with(body, substr(committee, 1, 12)) THEN id END) AS named FROM tk JOIN live USING (d) GROUP BY ticker)
SELECT ticker, CASE WHEN n = 1 THEN only_one ELSE named END AS meeting_id FROM j
""")
def ambiguous_match(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    tickers = o.select(F.col("o_orderkey").alias("ticker"), "date", F.col("o_orderpriority").alias("committee"))
    live = o.select(F.col("o_orderkey").alias("id"), "date", F.col("o_orderpriority").alias("body_name"))
    return rec.match_sessions(tickers, live).select("ticker", "meeting_id")


@query("SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o.o_custkey % 3 = l.l_suppkey % 3 THEN l.l_partkey END AS anchor FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey")
def consistent_link(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("o_custkey") % 3 == F.col("l_suppkey") % 3, F.col("l_partkey")).alias("anchor"))


@query("SELECT l_orderkey AS meeting_id, coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'R'), min(l_linenumber) FILTER (WHERE l_linestatus = 'O')) AS file_id FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' GROUP BY 1")
def carrier_pick(spark, sf):
    li = Tables(spark, sf).lineitem
    f = li.select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("id"), F.when(F.col("l_returnflag") == "R", "Einladung").otherwise("Anlage").alias("doc_type"), F.when(F.col("l_linestatus") != "O", "top1").alias("agenda_anchor"))
    return rec.carrier(f)


# ---------------------------------------------------------------- aggregates


@query("SELECT (SELECT count(*) FROM nation) AS bodies, (SELECT count(*) FROM orders) AS meetings, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE n_chars >= 20) AS with_text, (SELECT count(*) FROM labels WHERE quality = 1) AS enriched, (SELECT count(*) FROM events) AS votes, (SELECT count(*) FROM events WHERE props IS NOT NULL) AS votes_with_rollcall")
def stats(spark, sf):
    t = Tables(spark, sf)
    one = lambda df, *aggs: df.agg(*aggs)  # noqa: E731  each is one row
    n = F.count("*")
    parts = [
        one(t.nation, n.alias("bodies")), one(t.orders, n.alias("meetings")), one(t.documents, n.alias("documents"), F.count_if(F.col("n_chars") >= 20).alias("with_text")),
        one(t.labels, F.count_if(F.col("quality") == 1).alias("enriched")), one(t.events, n.alias("votes"), F.count_if(F.col("props").isNotNull()).alias("votes_with_rollcall")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


@query("SELECT count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'de' AND l.quality = 1")
def count_filtered(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return fc.facet_filter(d, fc.equal(F.col("lang"), "de"), F.col("quality") == 1).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS body_id, coalesce(nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END, ''), 'none') AS code, count(*) AS n FROM customer GROUP BY 1, 2")
def composition(spark, sf):
    c = Tables(spark, sf).customer
    return rec.composition(c.select(F.col("c_nationkey").alias("body_id"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("party_code"), F.lit("none").alias("party")))


@query("SELECT 'lang' AS facet, lang AS value FROM documents WHERE lang IS NOT NULL UNION SELECT 'source', source FROM documents WHERE source IS NOT NULL UNION SELECT 'event', event_type FROM events")
def facets(spark, sf):
    t = Tables(spark, sf)
    distinct = lambda df, c, name: df.where(F.col(c).isNotNull()).select(F.lit(name).alias("facet"), F.col(c).alias("value")).distinct()
    return distinct(t.documents, "lang", "lang").union(distinct(t.documents, "source", "source")).union(distinct(t.events, "event_type", "event"))


@query("SELECT c_nationkey AS person_id, min(c_name) FILTER (WHERE length(c_name) = m) AS name, count(*) AS memberships FROM (SELECT *, max(length(c_name)) OVER (PARTITION BY c_nationkey) AS m FROM customer) GROUP BY 1")
def people_rollup(spark, sf):
    t = Tables(spark, sf)
    m = t.customer.select(F.col("c_nationkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("body_id"), F.lit("p").alias("party"), F.lit("c").alias("party_code"), F.lit("r").alias("role"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    return rec.people(m, b).select("person_id", "name", F.size("memberships").cast("long").alias("memberships"))


@query("SELECT s_nationkey AS body_id, lower(s_name) AS surname, count(*) AS n FROM supplier GROUP BY 1, 2")
def two_level_count(spark, sf):
    from ..functions.text import surname

    return Tables(spark, sf).supplier.groupBy(F.col("s_nationkey").alias("body_id"), surname(F.col("s_name")).alias("surname")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def tally_pivot(spark, sf):
    g = Tables(spark, sf).lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count()
    return g.select("l_suppkey", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("A", "N", "R")))


@query("""
WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT p_partkey AS vorlage, o_custkey AS meeting_id, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS date, count(*) AS documents FROM part JOIN f ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2
""")
def lifecycle_chain(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    links = li.join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("id").alias("file_id"), F.col("p_partkey").alias("vorlage"), F.lit(False).alias("own"))
    o = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    nothing = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    files = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("id", F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("meeting_id"), *nothing("agenda_anchor", "label", "doc_type"), F.array().cast("array<string>").alias("submitters"))
    meetings = o.select(F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_custkey").alias("body_id"), F.col("d").alias("date"), F.lit(True).alias("public"), *nothing("body_name", "title"))
    agenda = meetings.where("false").select(F.col("id").alias("meeting_id"), *nothing("anchor", "number", "title"))
    votes = meetings.where("false").select(F.col("id").alias("meeting_id"), *nothing("agenda_anchor", "top_label", "result_text", "source"), *(F.lit(0).alias(c) for c in ("ja", "nein", "enthaltung")))
    s = rec.lifecycle(links, files, meetings, agenda, votes)
    return s.groupBy("vorlage", F.col("body_id").alias("meeting_id")).agg(F.min("date").cast("string").alias("date"), F.sum(F.size("documents")).alias("documents"))


@query("""
SELECT l_orderkey AS vorlage, min_by(CAST(l_linenumber AS VARCHAR), CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 9 END * 1000 + l_linenumber) AS title FROM lineitem GROUP BY 1
""")
def ranked_title(spark, sf):
    li = Tables(spark, sf).lineitem
    kind = F.when(F.col("l_returnflag") == "A", "Beschlussvorlage").when(F.col("l_returnflag") == "N", "Vorlage").otherwise("Anlage")
    files = li.select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_linenumber").cast("string").alias("label"), kind.alias("doc_type"))
    links = li.select(F.struct("l_orderkey", "l_linenumber").alias("file_id"), F.col("l_orderkey").alias("vorlage"), F.lit(True).alias("own"))
    return rec.proposal_title(links, files)


@query("SELECT o_custkey, max_by(o_orderkey, lpad(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 12, '0') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS o_orderkey FROM orders GROUP BY 1")
def latest_by(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"), F.concat(F.lit("termin-"), F.col("o_orderkey").cast("string")).alias("meeting"))
    return rec.latest_station(o, "o_custkey", "meeting", "date").select("o_custkey", "o_orderkey")


@query("SELECT count(*) AS seen, count(*) FILTER (WHERE event_type = 'error') AS errors, max(event_id) AS last FROM events")
def ingest_metrics(spark, sf):
    return Tables(spark, sf).events.agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("event_id").alias("last"))


@query("SELECT l_orderkey, coalesce(CAST(CASE WHEN l_linenumber <= 3 THEN l_linenumber END AS VARCHAR), 'extra') AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_with_extra(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber")
    agenda = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("anchor"))
    d = rec.group_with_rest(li, agenda, "l_orderkey", "l_linenumber")
    return d.groupBy("l_orderkey", F.coalesce(F.col("shown_under").cast("string"), F.lit("extra")).alias("bucket")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- order and pages


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) DESC) AS pos FROM orders ORDER BY o_orderdate DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) DESC LIMIT 50")
def sort_multi(spark, sf):
    from pyspark.sql import Window

    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").cast("string").desc()]
    top = fc.page(Tables(spark, sf).orders.select("o_orderkey", "o_orderdate"), order, 50)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("o_orderdate")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id DESC LIMIT 20 OFFSET 40")
def paginate(spark, sf):
    limit, offset = fc.clamped_bounds(20, 40, 200)
    return fc.page(Tables(spark, sf).documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.desc("doc_id")], limit, offset)


@query("SELECT * FROM (SELECT 'asc' AS dir, o_orderkey FROM orders ORDER BY o_orderdate ASC NULLS FIRST, o_orderkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'desc', o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 5)")
def sort_direction(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate")
    way = lambda d: F.asc("o_orderdate") if d.lower() == "asc" else F.desc("o_orderdate")
    one = lambda d: fc.page(o, [way(d), F.asc("o_orderkey")], 5).select(F.lit("asc" if d == "ASC" else "desc").alias("dir"), "o_orderkey")
    return one("ASC").union(one("sideways"))


@query("SELECT doc_id FROM documents d ORDER BY CASE WHEN n_chars < 200 THEN 0 ELSE 1 END, doc_id DESC LIMIT 30")
def sort_case(spark, sf):
    return fc.page(Tables(spark, sf).documents.select("doc_id", "n_chars"), [F.when(F.col("n_chars") < 200, 0).otherwise(1).asc(), F.desc("doc_id")], 30).select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 40")
def sort_dotted(spark, sf):
    from ..functions.text import dotted_order

    label = F.concat(F.lit("TOP "), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", label.alias("top_label"))
    return fc.page(li, [*dotted_order(F.col("top_label")), F.asc("l_partkey")], 40).select("l_orderkey", "l_linenumber")


@query("SELECT l.doc_id FROM (SELECT d.doc_id, CAST(q.quality AS VARCHAR) AS k FROM documents d LEFT JOIN labels q USING (doc_id)) l ORDER BY coalesce(k, '9999') DESC, doc_id LIMIT 25")
def sort_null_last(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").cast("string").alias("k")), "doc_id", "left")
    return fc.page(d, [F.coalesce("k", F.lit("9999")).desc(), F.asc("doc_id")], 25).select("doc_id")


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey DESC) FILTER (WHERE r <= 3) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) GROUP BY 1")
def nested_topn(spark, sf):
    g = Tables(spark, sf).orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("x"))
    return g.select("o_custkey", F.array_join(F.slice("x", 1, 3).cast("array<string>"), ",").alias("newest"))


@query("SELECT event_id FROM events ORDER BY ts + to_seconds(CAST(value AS INTEGER)), event_id LIMIT 15")
def live_sort(spark, sf):
    e = Tables(spark, sf).events.select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.rint("value").cast("decimal(18,6)"))).alias("win_end"))
    return fc.page(e, [F.asc("win_end"), F.asc("event_id")], 15).select("event_id")


@query("SELECT event_id FROM events ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 99 END, event_id DESC LIMIT 20")
def sort_custom_order(spark, sf):
    order = F.array(F.lit("purchase"), F.lit("click"))
    at = F.array_position(order, F.col("event_type"))
    return fc.page(Tables(spark, sf).events.select("event_id", "event_type"), [F.when(at == 0, 99).otherwise(at).asc(), F.desc("event_id")], 20).select("event_id")


# ---------------------------------------------------------------- sets


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_union(spark, sf):
    t = Tables(spark, sf)
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).union(t.customer.where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except(spark, sf):
    t = Tables(spark, sf)
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").distinct()


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ' ') AS links FROM pages")
def distinct_extract(spark, sf):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
    return Tables(spark, sf).pages.select("page_id", F.array_join(found, " ").alias("links"))


@query("SELECT doc_id FROM documents WHERE CAST(coalesce(nullif(regexp_extract(source, '[0-9]+'), ''), '0') AS BIGINT) > 15")
def prefix_cast(spark, sf):
    return Tables(spark, sf).documents.where(int_prefix(F.replace(F.col("source"), F.lit("src"), F.lit(""))) > 15).select("doc_id")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'a.*e')")
def like_pattern(spark, sf):
    return Tables(spark, sf).part.where(contains_ascii_ci(F.col("p_name"), "A%E")).select("p_partkey")


# ---------------------------------------------------------------- sources and sinks


@query("SELECT d.doc_id, length(d.text) AS chars, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def dump_text_join(spark, sf):
    t = Tables(spark, sf)
    return t.documents.select("doc_id", F.length("text").cast("long").alias("chars")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 25")
def slice_newest(spark, sf):
    return Tables(spark, sf).documents.select("doc_id").orderBy(F.col("doc_id").cast("long").desc()).limit(25)


@query("SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) >= 20 THEN 'ok' ELSE 'needs_ocr' END AS text_status FROM documents")
def text_status(spark, sf):
    from ..functions.text import text_status as status

    return Tables(spark, sf).documents.select("doc_id", status(F.col("text")).alias("text_status"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def to_json_rows(spark, sf):
    return Tables(spark, sf).nation.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))
