"""Writers of the store: rules of each table, and replays that change nothing."""

import datetime

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import merge
from quorumlake.plans.api import Store
from quorumlake.plans.writer import Writer

def now():
    return F.lit("2026-05-19 08:00:00").cast("timestamp")


@pytest.fixture
def writer(spark, tmp_path):
    return Writer(Store(spark, f"file://{tmp_path}"))


def rows(writer, table, *columns):
    return sorted(tuple(r) for r in writer.current(table).select(*columns).collect())


def test_meetings_agenda_members(spark, writer):
    m = spark.createDataFrame([("termin-1", "A", "u1"), ("termin-2", "B", "u2")], "id string, title string, url string")
    newer = spark.createDataFrame([("termin-1", None, "u9")], "id string, title string, url string")
    for _ in range(2):
        writer.meetings(m)
        writer.meetings(newer)
        assert rows(writer, "meetings", "id", "url") == [("termin-1", "u1"), ("termin-2", "u2")]
        assert writer.current("meetings").where("id = 'termin-1'").first().title is None
    agenda = lambda *x: spark.createDataFrame([*x], "meeting_id string, anchor string, first_seq long")
    for _ in range(2):
        writer.agenda(agenda(("termin-1", "top1", 0), ("termin-1", "top2", 1), ("termin-2", "top1", 0)))
        writer.agenda(agenda(("termin-1", "top3", 0)))
        assert rows(writer, "agenda_items", "meeting_id", "anchor") == [("termin-1", "top3"), ("termin-2", "top1")]
    writer.agenda(agenda(("x", "y", 0)).limit(0))
    assert len(rows(writer, "agenda_items", "anchor")) == 2
    for _ in range(2):
        writer.members(spark.createDataFrame([("b1", "1", "Anna"), ("b1", "2", "Karl"), ("b2", "1", "Anna")], "body_id string, person_id string, name string"))
        writer.members(spark.createDataFrame([("b1", "3", "Eva")], "body_id string, person_id string, name string"))
        assert rows(writer, "members", "body_id", "person_id") == [("b1", "3"), ("b2", "1")]


def test_bodies(spark, writer):
    body = lambda *x: spark.createDataFrame([*x], "id string, name string")
    later = F.lit("2026-06-01 08:00:00").cast("timestamp")
    for _ in range(2):
        writer.bodies(body(("g1", "Rat"), ("g2", "X")), True, now())
        writer.bodies(body(("g1", "other"), ("g3", "New")), False, later)
    assert rows(writer, "bodies", "id", "name") == [("g1", "Rat"), ("g2", "X"), ("g3", "New")]
    seen = {r.id: (r.first_seen, r.last_seen) for r in writer.current("bodies").collect()}
    assert seen["g1"][0] == datetime.datetime(2026, 5, 19, 8) and seen["g1"][1] == datetime.datetime(2026, 6, 1, 8)
    assert seen["g2"][1] == datetime.datetime(2026, 5, 19, 8)


def test_votes_fold_onto_what_is_there(spark, writer):
    def arrivals(*x):
        return spark.createDataFrame([*x], "seq long, meeting_id string, agenda_anchor string, source string, ja int, result_text string, members array<struct<name:string,vote:string>>")

    batches = [arrivals((1, "m", "top1", "live", 5, "ja", None)), arrivals((2, "m", "top1", "pdf", 6, None, [("A", "ja")])), arrivals((3, "m", "top1", "live", 9, "no", None), (4, "m", None, "live", 1, "x", None))]
    for b in [*batches, *batches[1:]]:
        writer.votes(b)
    v = writer.current("votes").collect()
    assert [(r.id, r.ja, r.result_text, r.source, len(r.members)) for r in v] == [("m:top1", 6, "ja", "pdf", 1)]


def test_files_by_change(spark, writer):
    schema = "id string, sha256 string, size long, remote_modified string, label string, meeting_id string, text_status string, ok boolean"
    first = [("1", "a", 1, "Mon", "L", "m1", "ok", True), ("2", "b", 1, "Mon", "L", "m1", "ok", True), ("3", "c", 1, "Mon", "L", "m1", "ok", True), ("4", "d", 1, "Mon", "L", "m1", "ok", True), ("9", "p", 5, "Mon", "L", "m1", "ok", False)]
    assert writer.files(spark.createDataFrame(first, schema), now(), F.col("ok")) == {"new": 4, "refused": 1}
    assert rows(writer, "files", "id", "enrich_status") == [(x, "pending") for x in "1234"]
    writer.commit("files", writer.current("files").withColumn("enrich_status", F.when(F.col("id") == "4", "skipped").otherwise("ok")))
    second = [("1", "z", 1, "Mon", "M", "m2", "ok", True), ("2", "b", 2, "Tue", "M", "m2", "ok", True), ("3", "html", 9, "Tue", "M", "m2", "error", False), ("4", "new", 9, "Tue", "M", "m2", "ok", True)]
    for want in ({"unchanged": 1, "touched": 1, "refused": 1, "changed": 1}, None):
        counts = writer.files(spark.createDataFrame(second, schema), now(), F.col("ok"))
        assert want is None or counts == want
        found = {r.id: (r.sha256, r.remote_modified, r.label, r.enrich_status) for r in writer.current("files").collect()}
        assert found == {"1": ("a", "Mon", "M", "ok"), "2": ("b", "Tue", "M", "ok"), "3": ("c", "Mon", "L", "ok"), "4": ("new", "Tue", "M", "skipped")}
        assert rows(writer, "file_versions", "file_id", "sha256") == [("4", "d")]


def test_seed_and_proposals(spark, writer):
    have = [("1", "ok", "mine", "m", "ok", "/1"), ("2", "empty", "old", "m", "skipped", None)]
    writer.commit("files", writer._shaped("files", spark.createDataFrame(have, "id string, text_status string, url string, label string, enrich_status string, local_path string")))
    dump = spark.createDataFrame([(i, f"d{i}", "label", "ok", ["CDU"], f"{i}.pdf") for i in "123"], "id string, url string, label string, text_status string, submitters array<string>, filename string")
    for _ in range(2):
        writer.seed(dump)
        if _ == 0:
            assert rows(writer, "files", "id", "url", "label", "text_status", "enrich_status") == [("1", "mine", "label", "ok", "ok"), ("2", "d2", "label", "ok", "skipped"), ("3", "d3", "label", "ok", "skipped")]
    numbers = lambda *x: spark.createDataFrame([*x], "file_id string, vorlage string, own boolean")
    writer.vorlagen(numbers(("1", "2026/0001", True), ("1", "2026/0002", False), ("2", "2026/0003", True)))
    writer.vorlagen(numbers(("1", "2026/0009", True)))
    assert rows(writer, "file_vorlagen", "file_id", "vorlage") == [("1", "2026/0009"), ("2", "2026/0003")]


def test_refresh_of_one_meeting(spark, writer):
    page = """<title>Rat (öffentlich)</title><table class="contenttable"><tr><td>Datum:</td><td>19. Mai 2026</td></tr></table><details class="top" id="dtop3"><span class="summary-title">3 - Haushalt</span></details>"""
    thing = {"id": "http://h/meetings/77", "name": "Ausschuss", "start": "2026-05-20T15:30:00+02:00", "agendaItem": [{"id": "i", "number": "1.", "name": "Eins"}]}
    for _ in range(2):
        assert writer.refresh("termin-5", "http://h/termin-5", {"http://h/termin-5": page}.get) == 1
        assert writer.refresh("77", "http://h/meetings/77", {"http://h/meetings/77": thing}.get) == 1
        assert writer.refresh("78", "gone", {}.get) == 0
        assert rows(writer, "meetings", "id", "title") == [("77", "Ausschuss"), ("termin-5", "Rat (öffentlich)")]
        assert rows(writer, "agenda_items", "meeting_id", "anchor") == [("77", "top1"), ("termin-5", "top3")]


def test_a_failed_commit_changes_nothing(spark, writer):
    writer.members(spark.createDataFrame([("b", "1", "A")], "body_id string, person_id string, name string"))
    broken = writer.current("members").withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        writer.commit("members", broken)
    assert rows(writer, "members", "name") == [("A",)]


def test_nothing_is_new_twice(spark):
    d = spark.createDataFrame([("1", 1, "Mon", "a")], "id string, size long, m string, sha string")
    assert [r.change for r in merge.classify_changes(d, d.limit(0), ["id"], "size", "m", "sha").collect()] == ["new"]
