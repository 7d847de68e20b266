import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import merge
from quorumlake.sources import external, feeds, oparl, pages

ROSTER = """<table class="contenttable"><tr><td>x</td></tr></table>
<table class="contenttable"><tr><th>Name</th><th>Info</th></tr>
<tr><td><a href="people-1">Dr. Anna  Müller</a><td>CDU, Vorsitz<td>x<td>seit 2019</tr>
<tr><td><a href="/people-2?x">Karl Schütz</a></td><td>Sachkundig</td><td>2014 - 2019</td></tr>
<tr><td><a href="people-1">Anna Müller</a></td><td>SPD, y</td></tr></table>
<table class="contenttable"><tr><td><a href="people-9">Z</a></td></tr></table>"""

MEETING = """<html><head><title>Stadt: Ratsinformation - Gemeinderat (öffentlich)</title></head><body><h1>H</h1>
<table class="contenttable"><tr><th>Datum:</th><td>19. Mai 2026, 15.30 bis 20 Uhr</td></tr><tr><td>Ort:</td><td>Bürgersaal</td></tr></table>
<details class="top" id="dtop3"><summary><span class="summary-title">3 - Haushalt <a class="anchor" href="#">#</a></span></summary><div class="detail-contents">öffentlich <a href="/downloadfiles/00123.pdf">Beschlussvorlage  A</a></div></details>
<details class="top" id="dtop3.1"><summary><span class="summary-title">3.1 – Teil #</span></summary><div class="detail-contents">nicht öffentlich</div></details>
<a href="/downloadfiles/00123.pdf">nochmal</a><a href="https://evil.example/downloadfiles/9.pdf">x</a><a href="https://ris.town.example/downloadfiles/plan.pdf"></a></body></html>"""


def test_roster(spark):
    df = spark.createDataFrame([("b1", ROSTER), ("b2", None), ("b3", "<table class='contenttable'></table>")], "body_id string, html string")
    rows = pages.rosters(pages.page_links(df, "body_id", "html"), "body_id").orderBy("body_id", "seq").collect()
    assert [(r.person_id, r.name, r.party, r.party_code, r.role, r.since) for r in rows] == [("1", "Dr. Anna Müller", "CDU", "CDU", "Vorsitz", "seit 2019"), ("2", "Karl Schütz", "", "", "Sachkundig", "2014 - 2019")]
    assert {r.body_id for r in rows} == {"b1"}


def test_meeting(spark):
    df = spark.createDataFrame([("termin-5", "https://ris.town.example/termin-5", MEETING), ("termin-6", None, None)], "id string, url string, html string")
    m = {r.id: r for r in pages.parse_meetings(df, "town.example", r"^Stadt: Ratsinformation - ").collect()}
    x = m["termin-5"]
    assert (x.title, x.body_name, x.date, x.time, x.location, x.public) == ("Gemeinderat (öffentlich)", "Gemeinderat", "2026-05-19", "15.30 bis 20 Uhr", "Bürgersaal", True)
    assert [tuple(a) for a in x.agenda] == [("top3", "3", "Haushalt", True), ("top3.1", "3.1", "Teil", False)]
    assert [(f.id, f.agenda_anchor, f.label, f.doc_type) for f in x.files][0] == ("00123", "top3", "Beschlussvorlage A", "Beschlussvorlage")
    assert len(x.files) == 2 and x.files[1].agenda_anchor is None and len(x.files[1].id) == 16 and x.files[1].label == "plan.pdf"
    assert m["termin-6"].files == [] and m["termin-6"].date is None


def test_committees_calendar_ticker(spark):
    links = lambda **html: pages.page_links(spark.createDataFrame([*html.items(), ("none", None)], "p string, html string"), "p", "html")
    named = links(x='<a href="x/organisation-gr-3">A  <b>b</b></a><a href="organisation-gr-3"> </a><a href="organisation-gr-3?y">C</a>')
    assert [tuple(r) for r in pages.committees(named, "p").collect()] == [("x", "organisation-gr-3", "C")]
    df = spark.createDataFrame([("termin-9 termin-10 termin-9",)], "h string")
    assert df.select(pages.calendar_ids(F.col("h")).alias("x")).first()["x"] == ["termin-10", "termin-9"]
    html = """<p>Sitzung. Gemeinderat (öffentlich) am 19. Mai 2026</p>
    <div><img src="https://h/file/highres1_TOP 1.jpg"> TOP 1 <strong>Ergebnis</strong><p>einstimmig
    angenommen</p></div><div>TOP 2.1<img src="https://h/file/highres2_TOP 2.1.jpg"></div><div>TOP 3 <strong>Ergebnis</strong><p>vertagt</p></div>"""
    found = pages.tickers(spark.createDataFrame([("1", html), ("2", None)], "id string, html string"), "id", "html")
    t, empty = found.orderBy("id").collect()
    assert (t.committee, str(t.date)) == ("Gemeinderat", "2026-05-19")
    assert [(x.top_label, x.result_text) for x in t.tops] == [("TOP 1", "einstimmig angenommen"), ("TOP 2.1", None)]
    assert (empty.committee, empty.date, empty.tops) == (None, None, [])
    votes = merge.merge_votes(pages.ticker_arrivals(found.withColumn("m", F.lit("termin-1")), "m", F.lit(1))).orderBy("id").collect()
    assert [(v.id, v.result_text, v.source) for v in votes] == [("termin-1:top1", "einstimmig angenommen", "live"), ("termin-1:top2.1", None, "live")]
    labels = spark.createDataFrame([("TOP 3.1",), ("TOP 4A",), ("TOP",)], "l string")
    assert [r.a for r in labels.select(pages.ticker_anchor(F.col("l")).alias("a")).collect()] == ["top3.1", "top4a", None]
    link = lambda i, t="": f"<div><p>Eine ganz normale lange Zeile <a href='/{i}/live'>x</a>{t}</p></div>"
    live = pages.live_tickers(links(some=link(5) + link(7, " jetzt live"), many="".join(map(link, range(10, 20)))), "p")
    assert sorted(map(tuple, live.collect())) == [*(("many", str(i)) for i in range(10, 16)), ("some", "7")]


def test_collections():
    site = {"u?limit=2&modified_since=2026%2B": {"data": [{"id": 1}], "links": {"next": "u?page=2&modified_since=2026+"}}, "u?page=2&modified_since=2026%2B": {"data": [{"id": 2}]}}
    assert [o["id"] for o in oparl.Collection("u", site.get, "2026+", 2).objects()] == [1, 2]
    for broken in ({"u?limit=2": None}, {"u?limit=2": {"data": "x"}}, {"u?limit=2": {"data": [], "links": {"next": "u?limit=2"}}}):
        with pytest.raises(oparl.CollectionError):
            list(oparl.Collection("u", broken.get, None, 2).objects())


def test_objects_by_link(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "u string")
    got = {r.url: (r.object, r.error) for r in oparl.fetch_objects(df, "u", lambda u: {"id": u} if u == "a" else None).collect()}
    assert got == {"a": ('{"id": "a"}', None), "b": (None, "no object"), None: (None, "no object")}


def test_collection_source(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            last = "page=2" in self.path
            body = {"data": [{"id": "b", "deleted": True}]} if last else {"data": [{"id": "a", "modified": "2026"}], "links": {"next": f"http://127.0.0.1:{self.server.server_port}/list?page=2"}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(oparl.CollectionSource)
    rows = spark.read.format("council-collection").option("page_size", 5).load(f"http://127.0.0.1:{server.server_port}/list").collect()
    server.shutdown()
    assert [(r.id, r.deleted, json.loads(r.object).get("modified")) for r in rows] == [("a", False, "2026"), ("b", True, None)]


def test_dump(spark, tmp_path):
    m, t = tmp_path / "meetings", tmp_path / "texts"
    m.mkdir()
    t.mkdir()
    f = lambda n, **x: {"fileName": f"{n}.pdf", "name": f"Anlage {n}", "downloadUrl": f"http://h/{n}", **x}
    meeting = {
        "id": "http://h/meetings/termin-5", "name": "Rat (nicht öffentlich)", "start": "2026-05-19T15:30:00+02:00", "end": "2026-05-19T20:00:00+02:00", "organization": ["http://h/organizations/gr/7"], "location": {"room": " ", "description": "Saal"},
        "agendaItem": [{"id": "i1", "number": "3.1.", "name": " Haus  halt ", "public": True, "resolutionFile": f("001"), "auxiliaryFile": [f("002", deleted=True)]}, {"id": "i2", "name": "ohne"}],
        "invitation": f("003"), "auxiliaryFile": [f("001"), f("x1")],
    }
    (m / "5.json").write_text(json.dumps(meeting))
    (m / "6.json").write_text(json.dumps({"id": "http://h/meetings/termin-6", "deleted": True}))
    (m / "7.json").write_text("{broken")
    (t / "17.txt").write_text("viel Text\nzwei")
    rows = oparl.read_objects(spark, str(m), oparl.MEETING)
    assert [(r.file, r.record) for r in oparl.broken_objects(spark, str(m), oparl.MEETING).collect()] == [("7.json", "{broken")]
    got = oparl.meeting_rows(rows).collect()
    assert [(r.id, r.body_id, str(r.date), r.time, r.location, r.public) for r in got] == [("termin-5", "organisation-gr-7", "2026-05-19", "15.30 bis 20 Uhr", "Saal", False)]
    assert [(r.anchor, r.title) for r in oparl.agenda_rows(rows).collect()] == [("top3.1", "Haus halt")]
    assert sorted((r.id, str(r.agenda_anchor)) for r in oparl.meeting_files(rows).collect()) == [("001", "top3.1"), ("003", "None")]
    assert [tuple(r) for r in oparl.read_texts(spark, str(t)).collect()] == [(17, "viel Text\nzwei")]


def test_external_boundaries(spark):
    df = spark.createDataFrame([("a", bytearray(b"x" * 30)), ("b", bytearray(b"no")), ("c", bytearray(b"!")), ("d", None)], "path string, content binary")

    def program(data):
        if data == b"!":
            raise RuntimeError
        return data.decode()

    assert {r.id: r.text_status for r in external.extract_texts(df, program).collect()} == {"a": "ok", "b": "needs_ocr", "c": "error", "d": "needs_ocr"}
    asked = external.ask(df.select("path", F.col("path").alias("prompt")), "path", "prompt", lambda xs: [json.dumps({"ja": 1, "category": "?", "summary_de": x}) for x in xs], 2)
    assert {r.id: (r.enrich_status, r.summary_de) for r in external.enriched(asked).collect()} == {x: ("ok", x) for x in "abcd"}
    assert {r.ja for r in external.read_votes(asked).collect()} == {1}


def test_feeds(spark):
    item = feeds.rss_item(F.lit("http://h"), F.lit("7"), F.lit("A & B"), F.lit("2026-05-19 08:00:00").cast("timestamp"), [F.lit("Antrag"), F.lit(None).cast("string")], F.lit("s"))
    assert spark.range(1).select(item.alias("x")).first()["x"] == '<item><title>A &amp; B</title><link>http://h/?doc=7</link><guid isPermaLink="false">7</guid><pubDate>Tue, 19 May 2026 08:00:00 +0000</pubDate><description>Antrag\n\ns</description></item>'
