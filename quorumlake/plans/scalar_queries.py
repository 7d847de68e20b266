"""Driver queries for scalar functions and page parsers, over strings made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, links, text, votes
from .registry import Tables, query



def _german(day):
    names = F.array(*map(F.lit, ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")))
    return F.concat(F.day(day).cast("string"), F.lit(". "), F.element_at(names, F.month(day)), F.lit(" "), F.year(day).cast("string"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 'R' WHEN p_name LIKE '%blue%' THEN 'B' WHEN p_name LIKE '%green%' THEN 'G' ELSE 'Sonstiges' END AS kind FROM part")
def classify(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", text.first_rule(F.col("p_name"), [("red", "R"), ("blue", "B"), ("green", "G")], text.OTHER).alias("kind"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Protokoll' WHEN 1 THEN 'Antrag' WHEN 2 THEN 'Vorlage' WHEN 3 THEN 'Antrag' ELSE 'Sonstiges' END AS kind FROM orders")
def map_fallback(spark, sf):
    k = F.col("o_orderkey") % 5
    label = F.when(k == 0, "Wortlaut Protokoll").when(k == 4, "Foto").otherwise("Schreiben")
    paper = F.when(k == 0, "Antrag").when(k == 1, "Änderungs-/Ergänzungsantrag").when(k == 2, "Informationsvorlage").when(k == 3, "Haushalt THH 4100")
    return Tables(spark, sf).orders.select("o_orderkey", text.document_type_of(label, paper).alias("kind"))


def _numbered(o):
    """Texts that name a proposal two ways and a range of budget years."""
    n, y = F.format_string("%04d", F.col("o_orderkey") % 10000), F.lit("2026")
    return F.concat(F.lit("Kopf\nVorlage: "), y, F.lit("/"), n, F.lit(" und Vorlagen-Nr. "), y, F.lit(" - "), n, F.lit("1, siehe Drucksache 2026/2027"))


@query("""
WITH o AS (SELECT o_orderkey, '2026/' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS n, o_orderkey % 10000 BETWEEN 2025 AND 2027 AS years FROM orders)
SELECT o_orderkey, CASE WHEN years THEN '' ELSE n || ' ' END || n || '1' AS refs, CASE WHEN years THEN n || '1' ELSE n END AS own FROM o
""")
def extract_codes(spark, sf):
    o = Tables(spark, sf).orders
    t = _numbered(o)
    return o.select("o_orderkey", F.array_join(text.proposal_references(F.lit("x"), t), " ").alias("refs"), text.own_number(F.lit(None).cast("string"), t, F.lit("Antrag")).alias("own"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE '2026/0' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS number FROM orders")
def normalize_code(spark, sf):
    n = F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2026 / 0"), n)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("2026-0"), n)).otherwise("2026/2027")
    return Tables(spark, sf).orders.select("o_orderkey", text.normal_number(raw).alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '2026/' || CAST(1000 + o_orderkey % 9000 AS VARCHAR) END AS base FROM orders")
def ref_base(spark, sf):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" 2026/"), (1000 + F.col("o_orderkey") % 9000).cast("string"), F.lit("/3"))).otherwise("DHH/2025/0001")
    return Tables(spark, sf).orders.select("o_orderkey", text.reference_base(raw).alias("base"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '\\bred\\b|rose') THEN 'R' END, CASE WHEN regexp_matches(p_name, '\\bgr[ae]+n') THEN 'G' END, CASE WHEN contains(p_type, 'STEEL') OR contains(p_name, 'steel') THEN 'S' END], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def multi_regex_tags(spark, sf):
    found = F.array_distinct(F.concat(text.tags(F.col("p_name"), [("R", [r"\bred\b", "rose"]), ("G", [r"\bgr[ae]+n"]), ("S", ["steel"])]), text.tags(F.col("p_type"), [("S", ["STEEL"])])))
    return Tables(spark, sf).part.select("p_partkey", F.array_join(found, ",").alias("tags"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'CDU,SPD' WHEN 1 THEN 'FDP' WHEN 2 THEN 'SVK' ELSE '' END AS codes FROM orders")
def derive_tags(spark, sf):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, "Antrag der CDU und SPD").when(k == 3, "Anlage").otherwise("Schreiben")
    body = F.when(k == 1, "Antrag der FDP-Fraktion").otherwise("ohne")
    kind = F.when(k.isin(0, 1), "Antrag").when(k == 2, "Protokoll").otherwise("Anlage")
    return Tables(spark, sf).orders.select("o_orderkey", F.array_join(text.submitters(label, body, kind), ",").alias("codes"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def parse_date_text(spark, sf):
    written = F.when(F.col("o_orderkey") % 7 == 0, "am 30. Februar 2026").otherwise(F.concat(F.lit("am "), _german("o_orderdate"), F.lit(", 15 Uhr")))
    return Tables(spark, sf).orders.select("o_orderkey", dates.german_date(written).cast("string").alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS public FROM orders")
def tri_state_flag(spark, sf):
    k = F.col("o_orderkey") % 4
    title = F.when(k == 0, "Rat (öffentlich)").when(k == 1, "Rat (nicht öffentlich)").when(k == 2, "Rat (öffentlich/nicht öffentlich)").otherwise("Rat")
    return Tables(spark, sf).orders.select("o_orderkey", text.meeting_public(title).alias("public"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE) + INTERVAL '15 hours 30 minutes', '%Y-%m-%d %H:%M') || '|' || strftime(CAST(o_orderdate AS DATE) + INTERVAL '20 hours', '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(CAST(o_orderdate AS DATE) + INTERVAL '22 hours', '%Y-%m-%d %H:%M') || '|' || strftime(CAST(o_orderdate AS DATE) + INTERVAL '24 hours 30 minutes', '%Y-%m-%d %H:%M') END AS win FROM orders")
def time_window(spark, sf):
    k = F.col("o_orderkey") % 4
    time = F.when(k == 0, "15.30 bis 20 Uhr").when(k == 1, "22.00 bis 0.30 Uhr").when(k == 2, "10-10 Uhr").otherwise("25 bis 26 Uhr")
    w = dates.time_window(time, F.to_date("o_orderdate"))
    shown = F.concat_ws("|", F.date_format(w["start"], "yyyy-MM-dd HH:mm"), F.date_format(w["end"], "yyyy-MM-dd HH:mm"))
    return Tables(spark, sf).orders.select("o_orderkey", F.when(w.isNotNull(), shown).alias("win"))


@query("SELECT event_id, CASE WHEN NOT (hour(ts) = 0 AND minute(ts) = 0) THEN CAST(hour(ts) AS VARCHAR) || CASE WHEN minute(ts) > 0 THEN '.' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') ELSE '' END || ' bis ' || CAST(hour(ts + INTERVAL 90 MINUTE) AS VARCHAR) || CASE WHEN minute(ts + INTERVAL 90 MINUTE) > 0 THEN '.' || lpad(CAST(minute(ts + INTERVAL 90 MINUTE) AS VARCHAR), 2, '0') ELSE '' END || ' Uhr' END AS win FROM events")
def format_window(spark, sf):
    return Tables(spark, sf).events.select("event_id", dates.german_window(F.col("ts"), F.col("ts") + F.expr("interval 90 minutes")).alias("win"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '')) AS surname, CASE WHEN c_custkey % 2 = 0 THEN 'f' END AS initial FROM customer")
def surname(spark, sf):
    last = F.replace(F.col("c_name"), F.lit("#"), F.lit(""))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Dr. Frank "), last)).otherwise(F.concat(F.lit("Prof. "), last))
    return Tables(spark, sf).customer.select("c_custkey", text.surname(name).alias("surname"), text.first_initial(name).alias("initial"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '')) AS surname, CASE WHEN c_custkey % 2 = 0 THEN 'k' END AS initial FROM customer")
def parse_roll_name(spark, sf):
    last = F.replace(F.col("c_name"), F.lit("#"), F.lit(""))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(last, F.lit(", K."))).otherwise(F.concat(F.lit("Dr."), last))
    return Tables(spark, sf).customer.select("c_custkey", text.roll_surname(name).alias("surname"), text.roll_initial(name).alias("initial"))


@query("SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents")
def casefold(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.casefold(F.col("text")).alias("folded"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Saal' WHEN 1 THEN o_orderpriority END AS place FROM orders")
def coalesce_blank(spark, sf):
    k = F.col("o_orderkey") % 3
    return Tables(spark, sf).orders.select("o_orderkey", text.first_filled(F.when(k == 0, " Saal ").otherwise("  "), F.when(k == 1, F.col("o_orderpriority")), F.lit("")).alias("place"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(rtrim(url, '/'), '[^/]*$') AS tail, CASE WHEN regexp_extract(url, '/([0-9]+)\.html', 1) <> '' THEN regexp_extract(url, '/([0-9]+)\.html', 1) ELSE substr(sha1(url), 1, 16) END AS id, (regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) = 'example.org' OR ends_with(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.example.org')) AS allowed FROM pages")
def url_parts(spark, sf):
    u = F.col("url")
    return Tables(spark, sf).pages.select("page_id", links.host(u).alias("host"), links.tail(u).alias("tail"), links.file_id(F.replace(u, F.lit(".html"), F.lit(".pdf"))).alias("id0"), links.allowed(u, "example.org").alias("allowed"), u.alias("u")).select(
        "page_id", "host", "tail", F.when(F.rlike("u", F.lit(r"/\d+\.html")), F.col("id0")).otherwise(links.file_id(F.col("u"))).alias("id"), "allowed")


@query(r"SELECT page_id, lower(regexp_extract(u, '^[^/]*//[^/?]*')) || substr(u, length(regexp_extract(u, '^[^/]*//[^/?]*')) + 1) AS url FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_source=[^&]*(&|$)', '\1'), '[?&]$', '') AS u FROM pages)")
def url_normalize(spark, sf):
    return Tables(spark, sf).pages.select("page_id", links.normal_url(F.col("url")).alias("url"))


@query("SELECT doc_id, sha256(text) AS sha, substr(sha1(text), 1, 16) AS id FROM documents")
def content_hash(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.sha2("text", 256).alias("sha"), text.content_id(F.col("text")).alias("id"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents")
def squash_ws(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.squash(F.col("text")).alias("t"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'ja' WHEN 'N' THEN 'enthaltung' ELSE 'abwesend' END AS choice FROM lineitem")
def alias_map(spark, sf):
    f = F.col("l_returnflag")
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", votes.choice(F.when(f == "A", " Dafür ").when(f == "N", "abstention").otherwise("??")).alias("choice"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS INTEGER) WHEN 1 THEN 2 WHEN 2 THEN 4 END AS n FROM orders")
def tolerant_int(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0 "))).when(k == 1, "2.5").when(k == 2, "3.5").otherwise("x")
    return Tables(spark, sf).orders.select("o_orderkey", text.tolerant_int(raw).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey AS INTEGER) END AS ja, CASE WHEN o_orderkey % 3 < 2 THEN 'Ada=ja' END AS members FROM orders")
def normalize_struct(spark, sf):
    k = F.col("o_orderkey") % 3
    good = F.concat(F.lit('{"ja": "'), F.col("o_custkey").cast("string"), F.lit('.0", "members": [{"name": " Ada ", "vote": "Yes"}, {"vote": "ja"}]}'))
    v = votes.vote_of(F.when(k == 0, good).when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise('{"members": []}'))
    return Tables(spark, sf).orders.select("o_orderkey", v["ja"].alias("ja"), F.array_join(F.transform(v["members"], lambda m: F.concat(m["name"], F.lit("="), m["vote"])), ",").alias("members"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_salvage(spark, sf):
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return Tables(spark, sf).events.select("event_id", F.from_json(votes.salvaged(reply), "k long")["k"].alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.nothing') IS NULL AS missing FROM events")
def json_decode(spark, sf):
    p = F.from_json("props", "k long, nothing string")
    return Tables(spark, sf).events.select("event_id", p["k"].alias("k"), p["nothing"].isNull().alias("missing"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE 'Sonstiges' END AS category, 'a|b' AS topics FROM customer")
def vocab_snap(spark, sf):
    j = F.concat(F.lit('{"category": "'), F.col("c_mktsegment"), F.lit('", "topics": ["a", {"name": " b "}, ""]}'))
    return Tables(spark, sf).customer.select("c_custkey", votes.category(F.get_json_object(j, "$.category"), ["building", "machinery"]).alias("category"), F.array_join(votes.enrichment(j)["topics"], "|").alias("topics"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE '0001-01-01 00:00:00' END AS k FROM orders")
def ts_key(spark, sf):
    k, iso = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(iso, F.lit("+02:00"))).when(k == 1, F.concat(iso, F.lit("Z"))).otherwise("soon")
    return Tables(spark, sf).orders.select("o_orderkey", F.date_format(dates.modified_key(raw), "yyyy-MM-dd HH:mm:ss").alias("k"))


@query("SELECT o_orderkey, CAST(CAST(m AS DATE) AS VARCHAR) AS month FROM (SELECT o_orderkey, unnest(generate_series(date_trunc('month', CAST(o_orderdate AS DATE)), date_trunc('month', CAST(o_orderdate AS DATE) + 65), INTERVAL 1 MONTH)) AS m FROM orders)")
def month_sequence(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", F.explode(dates.month_starts(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 65))).alias("m")).select("o_orderkey", F.col("m").cast("string").alias("month"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') AS xml FROM pages")
def xml_escape(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.xml_escape(F.col("html")).alias("xml"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'top9' WHEN 'N' THEN 'top' || l_orderkey || '.' || l_linenumber END AS anchor FROM lineitem")
def derive_anchor(spark, sf):
    f = F.col("l_returnflag")
    label = F.when(f == "R", "Anlage").otherwise(F.concat(F.lit("Ergebnis TOP "), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(" x")))
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", text.derived_anchor(F.when(f == "A", "top9"), label).alias("anchor"))


# ---------------------------------------------------------------- pages and feeds


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS n_links FROM pages")
def page_title_links(spark, sf):
    from ..sources.pages import link_count, page_title

    return Tables(spark, sf).pages.select("page_id", page_title(F.col("html")).alias("title"), link_count(F.col("html")).cast("long").alias("n_links"))


@query(r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS href FROM pages")
def page_links(spark, sf):
    from ..sources.pages import hrefs

    return Tables(spark, sf).pages.select("page_id", F.explode(F.array_distinct(hrefs(F.col("html")))).alias("href"))


@query("""SELECT doc_id, '<item><title>' || coalesce(source || ' &amp; ' || lang, CAST(doc_id AS VARCHAR)) || '</title><link>http://h/?doc=' || doc_id || '</link><guid isPermaLink="false">' || doc_id || '</guid><description>' || concat_ws(' · ', nullif(lang, ''), nullif(source, '')) || '</description></item>' AS item FROM documents""")
def rss_items(spark, sf):
    from ..sources.feeds import rss_item

    d = Tables(spark, sf).documents
    return d.select("doc_id", rss_item(F.lit("http://h"), F.col("doc_id").cast("string"), F.concat(F.col("source"), F.lit(" & "), F.col("lang")), F.lit(None).cast("timestamp"), [F.col("lang"), F.col("source")], F.lit(None).cast("string")).alias("item"))


@query(r"SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || '@h' || chr(13) || chr(10) || 'DTSTAMP:20260101T000000Z' || chr(13) || chr(10) || 'DTSTART;TZID=Europe/Berlin:' || strftime(o_orderdate, '%Y%m%d') || 'T153000' || chr(13) || chr(10) || 'DTEND;TZID=Europe/Berlin:' || strftime(o_orderdate, '%Y%m%d') || 'T200000' || chr(13) || chr(10) || 'SUMMARY:a\, b' || chr(13) || chr(10) || 'DESCRIPTION:t · ' || chr(13) || chr(10) || 'END:VEVENT' AS ics FROM orders")
def ics_rows(spark, sf):
    from ..sources.feeds import ics_event

    nothing = F.lit(None).cast("string")
    return Tables(spark, sf).orders.select("o_orderkey", ics_event(F.lit("h"), F.lit("20260101T000000Z"), F.col("o_orderkey").cast("string"), F.to_date("o_orderdate"), F.lit("15.30 bis 20 Uhr"), F.lit("a, b"), nothing, F.lit("t"), nothing).alias("ics"))
