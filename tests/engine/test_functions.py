"""Golden cases of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import dates, links, text, votes
from quorumlake.operators import facets, fts
from quorumlake.operators.rollcall import line


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def s(x):
    return F.lit(x).cast("string")


CASES = [
    (text.document_type, ["Wortprotokoll"], "Wortprotokoll"),
    (text.document_type, ["Protokoll mit Abstimmungsergebnis"], "Abstimmungsergebnis"),
    (text.document_type, ["Beschlussvorlage"], "Beschlussvorlage"),
    (text.document_type, ["Foto"], "Sonstiges"),
    (text.document_type, [None], "Sonstiges"),
    (text.paper_document_type, ["Haushalt THH 4100"], "Antrag"),
    (text.paper_document_type, ["Offenlage"], "Vorlage"),
    (text.paper_document_type, ["x"], None),
    (text.paper_document_type, [None], None),
    (text.proposal_numbers, ["Vorlage: 2026/0324"], ["2026/0324"]),
    (text.proposal_numbers, ["Vorlagen-Nr. 2026 / 0324"], ["2026/0324"]),
    (text.proposal_numbers, ["Vorlagennummer: 2026-0324"], []),
    (text.proposal_numbers, ["Vorlage Nr. 2026/0324"], []),
    (text.proposal_numbers, ["Drucksache 2025/12"], []),
    (text.normal_number, ["2026 / 0324"], "2026/0324"),
    (text.normal_number, ["2026-0324"], "2026/0324"),
    (text.normal_number, ["2026/2027"], None),
    (text.reference_base, ["2026/0365/3"], "2026/0365"),
    (text.reference_base, ["DHH/2025/0001"], None),
    (text.submitters, ["Antrag der CDU-Fraktion", None, "Antrag"], ["CDU"]),
    (text.submitters, ["x", None, "Protokoll"], ["SVK"]),
    (text.submitters, ["FDP/FW", None, "Anlage"], ["FDP", "FWV"]),
    (text.submitters, ["Anfrage", "Die Grünen und GRÜNE", "Anfrage"], ["B90"]),
    (text.submitters, ["Grüne", None, None], []),
    (text.submitters, ["ÜCDU CDUÜ", None, None], []),
    (dates.german_date, ["19. Mai 2026"], datetime.date(2026, 5, 19)),
    (dates.german_date, ["am 1. März 2024, 15 Uhr"], datetime.date(2024, 3, 1)),
    (dates.german_date, ["30. Februar 2026"], None),
    (dates.german_date, ["1. Foo 2026"], None),
    (dates.german_date, [None], None),
    (text.meeting_public, ["(öffentlich)"], True),
    (text.meeting_public, ["(nicht öffentlich)"], False),
    (text.meeting_public, ["(öffentlich/nicht öffentlich)"], None),
    (text.meeting_public, ["x"], None),
    (text.item_public, ["nichtöffentlich"], False),
    (text.surname, ["Dr. Frank Mentrup"], "mentrup"),
    (text.first_initial, ["Dr. Frank Mentrup"], "f"),
    (text.surname, ["Mentrup"], "mentrup"),
    (text.first_initial, ["Mentrup"], None),
    (text.surname, ["Eva Groß"], "gross"),
    (text.surname, [None], ""),
    (text.roll_surname, ["Schütz, K."], "schütz"),
    (text.roll_initial, ["Schütz, K."], "k"),
    (text.roll_surname, ["Dr.Huber"], "huber"),
    (text.roll_initial, ["Dr.Huber"], None),
    (text.roll_surname, [""], ""),
    (votes.choice, ["Dafür"], "ja"),
    (votes.choice, ["abstention"], "enthaltung"),
    (votes.choice, ["??"], "abwesend"),
    (votes.choice, [None], "abwesend"),
    (text.tolerant_int, ["5.0"], 5),
    (text.tolerant_int, ["2.5"], 2),
    (text.tolerant_int, ["x"], None),
    (text.tolerant_int, [None], None),
    (text.derived_anchor, [None, "Ergebnis TOP 3.1 x"], "top3.1"),
    (text.derived_anchor, ["top2", "TOP 3"], "top2"),
    (text.derived_anchor, ["", "nichts"], None),
    (text.squash, ["  a \n b\t"], "a b"),
    (text.int_prefix, ["12a"], 12),
    (text.int_prefix, [None], 0),
    (text.text_status, ["x" * 19], "needs_ocr"),
    (text.text_status, [" " + "x" * 20], "ok"),
    (text.text_status, [None], "needs_ocr"),
    (text.casefold, ["GROß Ä"], "gross ä"),
    (links.tail, ["http://h/a/b/"], "b"),
    (links.tail_number, ["termin-10007"], 10007),
    (links.tail_number, ["x"], -1),
    (links.body_id, ["http://h/organizations/gr/7"], "organisation-gr-7"),
    (links.body_id, ["http://h/organizations/at/7"], None),
    (links.file_id, ["http://h/00677201.PDF"], "00677201"),
    (votes.category, [" umwelt & KLIMA "], "Umwelt & Klima"),
    (votes.category, ["?"], "Sonstiges"),
    (text.ics_escape, ["a,b;c\\d\ne"], "a\\,b\\;c\\\\d\\ne"),
    (text.xml_escape, ["<a & b>"], "&lt;a &amp; b&gt;"),
]


def test_golden(spark):
    columns = [f(*map(s, args)).alias(f"c{i}") for i, (f, args, _) in enumerate(CASES)]
    got = spark.range(1).select(*columns).first()
    for i, (f, args, want) in enumerate(CASES):
        assert got[f"c{i}"] == want, (f.__name__, args, got[f"c{i}"])


@pytest.mark.parametrize(("time", "want"), [("15.30 bis 20 Uhr", ("15:30", 0, "20:00")), ("22.00 bis 0.30 Uhr", ("22:00", 1, "00:30")), ("15 – 20:15 uhr", ("15:00", 0, "20:15")), ("10-10 Uhr", None), ("25 bis 26 Uhr", None), ("18 Uhr", None), (None, None)])
def test_time_window(spark, time, want):
    got = value(spark, dates.time_window(s(time), F.to_date(F.lit("2026-05-19"))))
    if want is None:
        assert got is None
        return
    day = datetime.date(2026, 5, 19)
    assert (got.start.strftime("%H:%M"), (got.end.date() - day).days, got.end.strftime("%H:%M")) == want


def test_german_window(spark):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    assert value(spark, dates.german_window(at("2026-05-19 15:30:00"), at("2026-05-19 20:00:00"))) == "15.30 bis 20 Uhr"
    assert value(spark, dates.german_window(at("2026-05-19 00:00:00"), at("2026-05-19 20:00:00"))) is None
    assert value(spark, dates.german_window(at("2026-05-19 20:00:00"), at("2026-05-19 15:00:00"))) is None
    assert value(spark, dates.german_window(at("2026-05-19 20:00:00"), F.lit(None).cast("timestamp_ntz"))) is None


def test_like_ignores_case_of_ascii_only(spark):
    assert value(spark, text.like_ascii_ci(s("SCHÜTZ"), "schütz")) is False
    assert value(spark, text.like_ascii_ci(s("ABC"), "a_c")) is True
    assert value(spark, text.like_ascii_ci(s("a\\b"), "a\\b")) is True
    assert value(spark, text.contains_ascii_ci(s("xx50%yy"), "50%y")) is True


def test_dotted_order(spark):
    rows = [("TOP 3",), ("TOP 3.1",), ("TOP 4",), ("TOP 3.1.2",), ("TOP 10",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(*text.dotted_order(F.col("t"))).collect()]
    assert got == [(3, 0), (3, 1), (4, 0), (3, 1), (10, 0), (0, 0)]


def test_vote_and_enrichment_json(spark):
    vote = lambda x: value(spark, votes.vote_of(s(x)))
    got = vote('```json\n{"ja": "5.0", "nein": 2, "members": [{"name": " A ", "vote": "YES"}, {"vote": "ja"}, {"name": "B"}]}\n```')
    assert (got.ja, got.nein, got.enthaltung, [tuple(m) for m in got.members]) == (5, 2, None, [("A", "ja"), ("B", "abwesend")])
    assert vote('{"members": []}') is None and vote("no json") is None and vote(None) is None
    e = value(spark, votes.enrichment(s('x {"summary_de": " d ", "category": "verkehr & mobilität", "topics": "a, b,,", "entities": {"people": ["p", {"name": "q"}, ""], "orgs": "o1,o2"}} y')))
    assert (e.summary_de, e.summary_en, e.category, e.topics, e.entities.people, e.entities.locations) == ("d", "", "Verkehr & Mobilität", ["a", "b"], ["p", "q"], [])
    assert value(spark, votes.enrichment(s("nothing"))) is None


def test_modified_key(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = lambda x: value(spark, F.date_format(dates.modified_key(s(x)), "yyyy-MM-dd HH:mm"))
    assert key("2026-07-25T16:46:24+02:00") == "2026-07-25 14:46"
    assert key("2026-07-25T16:46:24Z") == "2026-07-25 16:46"
    assert key("2026-07-25T16:46:24") == "2026-07-25 14:46"
    assert key("soon") == key(None) == "0001-01-01 00:00"


def test_line_ties(spark):
    n = lambda a, b, c: value(spark, line(F.lit(a), F.lit(b), F.lit(c)))
    assert [n(2, 2, 0), n(1, 2, 2), n(0, 0, 1), n(0, 0, 0)] == ["ja", "nein", "enthaltung", None]


def test_links():
    url = links.with_parameters("https://h/p?limit=10&modified_since=2026-07-25T16:46:24+02:00&page=2", modified_since="2026-07-25T16:46:24+02:00")
    assert url == "https://h/p?limit=10&page=2&modified_since=2026-07-25T16%3A46%3A24%2B02%3A00"
    assert links.with_parameters("https://h/p?x=1", modified_since=None) == "https://h/p?x=1"


def test_bounds_and_flags():
    assert facets.clamped_bounds(900, -3, 200) == (200, 0)
    with pytest.raises(ValueError):
        facets.checked_bounds(0, 0, 200)
    assert [facets.parse_flag(x) for x in (None, "", "all", "1", "public", "no")] == [None, None, None, True, True, False]


def test_query_phrases():
    assert fts.query_phrases("foo-bar (x)") == [["foo", "bar"], ["x"]]
    assert fts.query_phrases("!! --") == []
    assert fts.query_phrases("Schöne Straße") == [["schone"], ["straße"]]


def test_modified_key_in_any_zone(spark):
    df = spark.createDataFrame([("2026-07-25T16:46:24",), ("2026-07-25T16:46:24+02:00",), ("2026-07-25",), ("2026-01-25 10:00:00",), ("soon",), (None,)], "c string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    for z in ("UTC", "Europe/Berlin", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", z)
        found.append([r.s for r in df.select(F.unix_micros(dates.modified_key(F.col("c"))).alias("s")).collect()])
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert found[0] == found[1] == found[2]
    assert [x // 10**6 for x in found[0][:4]] == [1784990784, 1784990784, 1784930400, 1769331600] and found[0][4] == found[0][5] == -62135596800 * 10**6


def test_queries_fold_as_the_index_does(spark):
    from quorumlake.operators import fts

    rows = [(1, "Tiếng Việt"), (2, "ǎbc"), (3, "Müller Straße"), (4, "Cafe\u0301")]
    d = spark.createDataFrame(rows, "id long, t string")
    posted, sizes = fts.postings(d, "id", ["t"]), fts.lengths(d, "id", ["t"])
    found = lambda q: {r.doc for r in fts.search(posted, sizes, q).collect()}
    assert (found("Tiếng"), found("ǎbc"), found("muller STRASSE"), found("Müller-Straße"), found("Café"), found("cafe")) == ({1}, {2}, set(), {3}, {4}, {4})


def test_state_is_replaced_whole(spark, tmp_path):
    from quorumlake.streaming.votes import StateFile

    state = StateFile(spark, f"file://{tmp_path}/state")
    assert state.get("k") is None
    for value in ({"a": 1}, ["ü"], "2026"):
        state.set("k", value)
        assert state.get("k") == value
