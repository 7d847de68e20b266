"""The served operations as functions over the store's tables.

Each returns DataFrames (or a text for calendar and feed); nothing is collected but what a text
holds.  ``now`` and ``today`` are arguments, so results can be repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import casefold, contains_ascii_ci, dotted_order
from ..operators import facets as fc
from ..operators import fts, records, rollcall
from ..sources import feeds

#: Columns of a document in lists; texts stay in a table of their own.
DOCUMENT = ["id", "url", "meeting_id", "agenda_anchor", "label", "doc_type", "filename", "text_status", "enrich_status", "summary_de", "summary_en", "category", "topics", "entities", "submitters", "vorlage", "paper_type", "downloaded_at"]
SEARCHED = ["label", "fulltext", "summary_de", "summary_en", "topics", "category", "body_name", "meeting_title"]
LIMITS = {"search": 200, "meetings": 500, "recent": 200, "feed": 100}


@dataclass
class Page:
    total: DataFrame
    rows: DataFrame


class Store:
    """Tables under a folder, one Parquet table each (see ``schemas``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    # -------------------------------------------------------- documents

    def documents(self) -> DataFrame:
        f = self.table("files").select(DOCUMENT)
        return records.with_agenda(records.with_meeting(f, self.table("meetings")), self.table("agenda_items"))

    def searchable(self) -> DataFrame:
        d = self.documents().join(self.table("fulltexts"), "id", "left")
        return d.select("id", *(F.concat_ws(" ", c).alias(c) if c == "topics" else F.col(c) for c in SEARCHED))

    def build_index(self, folder: str) -> None:
        """Postings and lengths of all documents, for ``search_documents``."""
        d = self.searchable()
        fts.write_index(fts.postings(d, "id", SEARCHED), f"{folder}/postings")
        fts.lengths(d, "id", SEARCHED).write.mode("overwrite").parquet(f"{folder}/lengths")

    def search_documents(self, query: str | None = None, *, committee=None, doc_type=None, date_from=None, date_to=None, public=None, topic=None, submitter=None, limit=50, offset=0, index: str | None = None) -> Page:
        """Faceted search; with a query ranked by BM25, with a snippet, else newest meeting first."""
        d = fc.facet_filter(
            self.documents(), fc.name_or_id(F.col("body_name"), F.col("body_id"), committee), fc.equal(F.col("doc_type"), doc_type), *fc.dates(F.col("meeting_date"), date_from, date_to),
            fc.flag(F.col("meeting_public"), public), fc.has_tag(F.col("topics"), topic), fc.has_tag(F.col("submitters"), submitter),
        )
        order = [F.col("meeting_date").desc(), F.col("id").desc()]
        if query:
            if index:
                posted, sizes = fts.read_index(self.spark, f"{index}/postings"), self.spark.read.parquet(f"{index}/lengths")
            else:
                text = self.searchable()
                posted, sizes = fts.postings(text, "id", SEARCHED), fts.lengths(text, "id", SEARCHED)
            d = d.join(fts.search(posted, sizes, query).select(F.col("doc").alias("id"), F.col("score").alias("rank")), "id")
            order = [F.col("rank").asc(), F.col("id").desc()]
        rows = fc.page(d, order, limit, offset)
        if query:  # texts of the page alone are read
            rows = rows.join(self.table("fulltexts"), "id", "left").withColumn("snippet", fts.snippet(F.concat_ws(" ", "label", "summary_de", "fulltext"), query)).drop("fulltext").orderBy(*order)
        return Page(d.agg(F.count("*").alias("total")), rows)

    def document(self, id_: str, chars: int | None = None) -> dict[str, DataFrame]:
        d = self.documents().where(F.col("id") == id_).limit(1).join(self.table("fulltexts").where(F.col("id") == id_), "id", "left")
        if chars:
            d = d.withColumn("fulltext", F.substring("fulltext", 1, chars))
        versions = self.table("file_versions").where(F.col("file_id") == id_).orderBy(F.desc("superseded_at"))
        links = self.table("file_vorlagen").where(F.col("file_id") == id_).select("vorlage", "own").orderBy(F.desc("own"), "vorlage")
        return {"document": d, "versions": versions, "vorlagen": links}

    def recent_documents(self, since=None, *, committee=None, doc_type=None, submitter=None, topic=None, limit=50) -> DataFrame:
        d = fc.facet_filter(
            self.documents(), F.col("downloaded_at") >= F.lit(since) if since else None, fc.name_or_id(F.col("body_name"), F.col("body_id"), committee), fc.equal(F.col("doc_type"), doc_type),
            fc.has_tag(F.col("submitters"), submitter), fc.has_tag(F.col("topics"), topic),
        )
        return fc.page(d, [F.desc("downloaded_at"), F.desc("id")], limit)

    def file_location(self, id_: str, version: int | None = None) -> DataFrame:
        """Where a file, or an archived version of it, is kept, and its link as a fallback."""
        if version is None:
            return self.table("files").where(F.col("id") == id_).select("local_path", "filename", "url")
        return self.table("file_versions").where((F.col("file_id") == id_) & (F.col("id") == version)).select("local_path")

    # -------------------------------------------------------- committees and meetings

    def committees(self) -> DataFrame:
        b = self.table("bodies").select("id", "name")
        m = self.table("meetings").select(F.col("id").alias("meeting_id"), "body_id")
        docs = self.table("files").select("meeting_id").join(m, "meeting_id")
        for counted, name in ((self.table("members"), "members"), (m, "meetings"), (docs, "documents")):
            b = records.with_count(b, "id", counted, "body_id", name)
        return b.orderBy("name")

    def committee(self, id_: str) -> dict[str, DataFrame]:
        members = self.table("members").where(F.col("body_id") == id_)
        m = self.table("meetings").where(F.col("body_id") == id_).select(F.col("id").alias("meeting_id"))
        return {
            "committee": self.table("bodies").where(F.col("id") == id_), "members": members.drop("body_id").orderBy("name"),
            "composition": records.composition(members).drop("body_id").orderBy(F.desc("n"), "code"),
            "documents": self.table("files").join(m, "meeting_id", "left_semi").agg(F.count("*").alias("n")), "meetings": self.meetings(committee=id_, limit=300).rows,
        }

    def meetings(self, *, committee=None, date_from=None, date_to=None, order="desc", limit=100, offset=0) -> Page:
        m = fc.facet_filter(self.table("meetings"), fc.name_or_id(F.col("body_name"), F.col("body_id"), committee), *fc.dates(F.col("date"), date_from, date_to))
        total = m.agg(F.count("*").alias("total"))
        way = F.col("date").asc() if str(order).lower() == "asc" else F.col("date").desc()
        m = fc.page(m, [way, F.col("id").asc()], limit, offset)
        m = records.with_count(m, "id", self.table("files"), "meeting_id", "documents")
        return Page(total, records.with_count(m, "id", self.table("agenda_items"), "meeting_id", "agenda_count").orderBy(way, "id"))

    def meeting(self, id_: str) -> dict[str, DataFrame]:
        own = lambda name: self.table(name).where(F.col("meeting_id") == id_)
        return {
            "meeting": self.table("meetings").where(F.col("id") == id_), "agenda_items": own("agenda_items").orderBy("first_seq"),
            "files": records.with_agenda(own("files").select(DOCUMENT), self.table("agenda_items")).orderBy("id"), "votes": self.meeting_votes(id_),
        }

    def live_meetings(self, now: Column) -> DataFrame:
        """Sessions under way at a local time, those that end soonest first; yesterday's may still run."""
        from ..streaming.watermarks import live_now

        day = F.to_date(now)
        m = self.table("meetings").where(F.col("date").isin(day, F.date_sub(day, 1)) & (F.coalesce("time", F.lit("")) != ""))
        m = m.withColumn("win", dates.time_window(F.col("time"), F.col("date"))).where("win is not null")
        return live_now(m, F.col("win.start"), F.col("win.end"), now).orderBy("win.end", "id")

    def calendar(self, today: Column, stamp: str, domain: str, committee=None) -> str:
        m = self.meetings(committee=committee, order="asc", limit=500, date_from=F.date_sub(today, 30)).rows.where("date is not null")
        summary = F.coalesce(F.when(F.col("body_name") != "", F.col("body_name")), F.when(F.col("title") != "", F.col("title")), F.lit("Sitzung"))
        e = m.select("date", "id", feeds.ics_event(F.lit(domain), F.lit(stamp), F.col("id"), F.col("date"), F.col("time"), summary, F.col("location"), F.col("title"), F.col("url")).alias("ics"))
        return feeds.ics_calendar(e, [F.asc("date"), F.asc("id")], committee or "Sitzungskalender")

    def feed(self, base: str, title: str, **filters) -> str:
        limit = filters.pop("limit", 50)
        d = self.recent_documents(limit=limit, **filters)
        items = d.select("downloaded_at", "id", feeds.rss_item(F.lit(base), F.col("id"), F.col("label"), F.col("downloaded_at"), [F.col("doc_type"), F.col("body_name"), F.col("meeting_date")], F.col("summary_de")).alias("item"))
        shown = [v for v in filters.values() if v]
        return feeds.rss_channel(items, [F.desc("downloaded_at"), F.desc("id")], title + (f" — {' · '.join(shown)}" if shown else ""), base, "Neu archivierte Dokumente", limit)

    # -------------------------------------------------------- votes and people

    def meeting_votes(self, id_: str) -> DataFrame:
        return self.table("votes").where(F.col("meeting_id") == id_).orderBy(*dotted_order(F.col("top_label")), "top_label")

    def search_votes(self, *, committee=None, date_from=None, date_to=None, member=None, query=None, include_members=False, limit=50, offset=0) -> Page:
        """Votes of all meetings, newest first; ``member_votes`` are the roll call's entries that name a member."""
        v = records.with_agenda(records.with_meeting(self.table("votes"), self.table("meetings"), "inner"), self.table("agenda_items"))
        named = F.exists(F.coalesce("members", F.array()), lambda x: contains_ascii_ci(x["name"], member)) if member else None
        v = fc.facet_filter(v, fc.name_or_id(F.col("body_name"), F.col("body_id"), committee), *fc.dates(F.col("meeting_date"), date_from, date_to), named, fc.any_contains([F.col("top_label"), F.col("result_text"), F.col("agenda_title")], query))
        total = v.agg(F.count("*").alias("total"))
        if member:
            folded = F.lit(member.casefold())
            v = v.withColumn("member_votes", F.filter("members", lambda x: F.contains(casefold(x["name"]), folded)))
        rows = fc.page(v, [F.col("meeting_date").desc(), *dotted_order(F.col("top_label")), F.col("id").asc()], limit, offset)
        return Page(total, rows if include_members else rows.drop("members"))

    def roll_entries(self) -> DataFrame:
        v = self.table("votes").join(self.table("meetings").select(F.col("id").alias("meeting_id"), "body_id", "body_name", F.col("date").alias("meeting_date")), "meeting_id")
        e = v.select(F.col("id").alias("vote_id"), "meeting_id", "agenda_anchor", "top_label", "result_text", "source", "body_id", "body_name", "meeting_date", F.posexplode("members").alias("position", "m"))
        return e.select("*", F.col("m.name").alias("name"), F.col("m.vote").alias("vote")).drop("m")

    def people(self, name: str | None = None) -> DataFrame:
        p = records.people(self.table("members"), self.table("bodies"))
        return fc.facet_filter(p, F.contains(casefold(F.col("name")), F.lit(name.casefold())) if name else None).orderBy("surname", "person_id")

    def person(self, id_: str) -> dict[str, DataFrame]:
        """A person, roll-call votes newest first, and their tally.  The name comes to the driver."""
        m = self.table("members")
        p = records.people(m.where(F.col("person_id") == id_), self.table("bodies"))
        name = [r.name for r in p.select("name").collect()]
        votes = rollcall.person_votes(self.roll_entries(), m, name[0] if name else "").orderBy(F.desc("meeting_date"), "vote_id")
        return {"person": p, "votes": votes, "vote_summary": votes.groupBy("vote").count()}

    def lifecycle(self, number: str) -> dict[str, DataFrame]:
        if not re.fullmatch(r"20\d{2}/\d{3,5}", number):
            raise ValueError("a number looks like 2026/0324")
        links = self.table("file_vorlagen").where(F.col("vorlage") == number)
        files = self.table("files")
        stations = records.lifecycle(links, files.select("id", "label", "doc_type", "meeting_id", "agenda_anchor", "submitters"), self.table("meetings"), self.table("agenda_items"), self.table("votes"))
        return {"title": records.proposal_title(links, files), "stations": stations.orderBy(F.coalesce(F.col("date").cast("string"), F.lit("9999")), F.coalesce("meeting_id", F.lit("")))}

    def analytics(self) -> dict[str, DataFrame]:
        """Party cohesion, agreement and dissent over all roll calls."""
        e = rollcall.attribute(self.roll_entries(), self.table("members")).persist()
        lines = rollcall.party_lines(rollcall.party_counts(e)).persist()
        voted = self.table("votes").join(self.table("meetings").select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")
        return {
            "totals": rollcall.vote_totals(voted), "parties": rollcall.cohesion(lines).orderBy(F.desc("votes"), "party"), "agreement": rollcall.agreement(lines).orderBy("a", "b"),
            "dissenters": rollcall.top_dissenters(rollcall.dissent(e, lines)), "unattributed": e.where("party is null").agg(F.count("*").alias("unattributed_entries")),
        }

    # -------------------------------------------------------- whole store

    def facets(self) -> dict[str, DataFrame]:
        f = self.table("files")
        return {
            "committees": self.table("bodies").select("id", "name").orderBy("name"), "doc_types": f.where("doc_type is not null").select("doc_type").distinct().orderBy("doc_type"),
            "submitters": f.select(F.explode("submitters").alias("submitter")).distinct().orderBy("submitter"),
        }

    def stats(self) -> DataFrame:
        n = lambda name, *aggs: self.table(name).agg(*aggs)  # noqa: E731  one row each
        one = F.count("*")
        parts = [
            n("bodies", one.alias("bodies")), n("meetings", one.alias("meetings")),
            n("files", one.alias("documents"), F.count_if(F.col("text_status") == "ok").alias("with_text"), F.count_if(F.col("enrich_status") == "ok").alias("enriched")),
            n("votes", one.alias("votes"), F.count_if(F.col("members").isNotNull()).alias("votes_with_rollcall")),
            n("meta", F.max(F.when(F.col("key") == "last_scrape", F.col("value"))).alias("last_scrape"), F.max(F.when(F.col("key") == "last_scrape_status", F.col("value"))).alias("last_scrape_status")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(F.broadcast(p))
        return out

    def refresher(self, meeting_id: str, html_ids: str = "termin-") -> str:
        """Which ingester refreshes a meeting: pages for scraped ids, objects otherwise."""
        return "pages" if meeting_id.startswith(html_ids) else "objects"


def rounded(value: float | None, digits: int = 3) -> float | None:
    """Rounds the few ratios that are shown, as Python does."""
    return None if value is None else round(value, digits)


