"""Registered queries work on whole values and all rows; expectations are stated here, not taken from the registered SQL."""

import datetime

import pytest

from quorumlake import plans
from quorumlake.operators import records as rec


@pytest.fixture
def run(spark, tmp_path):
    """The rows of a query over the given tables: name -> (schema, rows)."""

    def go(name, **tables):
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return sorted(tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).collect())

    return go


def test_recompute_sees_markers_anywhere(run):
    far = "x " * 5000
    docs = [(1, far + "Apache"), (2, far + "the MIT License"), (3, far), (4, None), (5, "apache")]
    assert run("recompute", documents=("doc_id long, text string", docs)) == [(1, "A"), (2, "M"), (3, "none"), (4, "none"), (5, "A")]


def test_scalars_take_whole_values_of_all_rows(run):
    docs = [(1, "en", "Ab " * 400 + "STRASSE"), (2, "de", "Ab " * 400 + "Straße"), (3, None, None)]
    table = ("doc_id long, lang string, text string", docs)
    assert run("casefold", documents=table) == [(1, "ab " * 400 + "strasse"), (2, "ab " * 400 + "strasse"), (3, None)]
    spaced = ("doc_id long, text string", [(1, " a \n\t b" * 500)])
    assert run("squash_ws", documents=spaced) == [(1, " ".join(["a b"] * 500))]
    assert run("xml_escape", pages=("page_id long, html string", [(1, "<p>" * 200 + "&")])) == [(1, "&lt;p&gt;" * 200 + "&amp;")]


def test_every_order_has_its_months_and_codes(run):
    day = datetime.date(1996, 1, 31)
    orders = ("o_orderkey long, o_orderdate date", [(k, day) for k in (1, 2, 2025, 2027, 12026)])
    want = ["1996-01-01", "1996-02-01", "1996-03-01", "1996-04-01"]
    assert run("month_sequence", orders=orders) == [(k, m) for k in (1, 2, 2025, 2027, 12026) for m in want]
    # 2026/2025, 2026/2026 and 2026/2027 are budget years, the longer number is none
    assert run("extract_codes", orders=orders) == [(1, "2026/0001 2026/00011", "2026/0001"), (2, "2026/0002 2026/00021", "2026/0002"), (2025, "2026/20251", "2026/20251"), (2027, "2026/20271", "2026/20271"), (12026, "2026/20261", "2026/20261")]


def test_every_order_is_a_ticker(run):
    day, other = datetime.date(1996, 1, 1), datetime.date(1996, 1, 2)
    orders = [(1, day, "1-URGENT"), (2, day, "2-HIGH"), (13, day, "2-HIGH"), (24, other, "5-LOW")]
    found = run("ambiguous_match", orders=("o_orderkey long, o_orderdate date, o_orderpriority string", orders))
    assert found == [(1, 1), (2, 2), (13, 2), (24, 24)]


def test_match_sessions(spark):
    live = spark.createDataFrame([("a", "d1", None), ("b", "d2", "Hauptausschuss Nord"), ("c", "d2", "Hauptausschuss"), ("d", "d2", "Rat"), ("e", None, "Rat"), ("f", "d3", None), ("g", "d3", None)], "id string, date string, body_name string")
    rows = [(1, "d1", None), (2, "d2", "Hauptausschuss Süd"), (3, "d2", "Haupt"), (4, "d2", "Rat"), (5, "d2", "Rates"), (6, "d2", ""), (7, "d2", None), (8, None, "Rat"), (9, "d4", "Rat"), (10, "d3", "Rat"), (4, "d2", "Rat")]
    found = rec.match_sessions(spark.createDataFrame(rows, "ticker int, date string, committee string"), live)
    assert {r["ticker"]: r["meeting_id"] for r in found.collect()} == {1: "a", 2: "b", 3: "b", 4: "d", 5: None, 6: None, 7: None, 8: None, 9: None, 10: None}
    assert found.count() == 10


def test_lifecycle_chain_follows_every_part(run):
    part = ("p_partkey long, p_size int", [(1, 5), (2, 10), (3, 50)])
    items = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", [(7, 1, 1, 1), (7, 2, 2, 1), (7, 3, 3, 1), (7, 4, 3, 1)])
    orders = ("o_orderkey long, o_custkey long, o_orderdate date", [(7, 4, datetime.date(1996, 1, 1))])
    found = run("lifecycle_chain", part=part, lineitem=items, orders=orders)
    assert sorted((r[0], r[1], r[3]) for r in found) == [(1, 4, 1), (2, 4, 1), (3, 4, 2)]


def test_text_status_looks_behind_leading_spaces(run):
    docs = ("doc_id long, text string", [(1, " " * 30 + "prose " * 10), (2, " " * 30 + "short"), (3, None), (4, "prose " * 10)])
    assert run("text_status", documents=docs) == [(1, "ok"), (2, "needs_ocr"), (3, "needs_ocr"), (4, "ok")]
