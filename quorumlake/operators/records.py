"""Joins and nested results over the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import surname


def with_count(df: DataFrame, key: str, counted: DataFrame, counted_key: str, name: str) -> DataFrame:
    """A count for each row, 0 without any; the other side is aggregated first, so nothing fans out."""
    n = counted.where(F.col(counted_key).isNotNull()).groupBy(F.col(counted_key).alias("_k")).agg(F.count("*").alias(name))
    return df.join(n, df[key] == n["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def with_agenda(files: DataFrame, agenda: DataFrame) -> DataFrame:
    """Number and title of the agenda item a file hangs under; the agenda has one row for each key."""
    a = agenda.select(F.col("meeting_id").alias("_m"), F.col("anchor").alias("_a"), F.col("number").alias("agenda_number"), F.col("title").alias("agenda_title"))
    return files.join(a, (files["meeting_id"] == a["_m"]) & (files["agenda_anchor"] == a["_a"]), "left").drop("_m", "_a")


def with_meeting(files: DataFrame, meetings: DataFrame, how: str = "left") -> DataFrame:
    m = meetings.select(F.col("id").alias("_m"), "body_id", "body_name", F.col("date").alias("meeting_date"), F.col("title").alias("meeting_title"), F.col("public").alias("meeting_public"))
    return files.join(m, files["meeting_id"] == m["_m"], how).drop("_m")


def people(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """A row for each person: the longest name, of equally long ones the first, and the memberships."""
    m = members.join(bodies.select(F.col("id").alias("body_id"), F.col("name").alias("body_name")), "body_id")
    first = lambda c: F.min_by(c, F.struct("name", "body_id"))
    out = m.groupBy("person_id").agg(
        F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name"), first("party").alias("party"), first("party_code").alias("party_code"),
        F.array_sort(F.collect_list(F.struct("body_id", "body_name", "role"))).alias("memberships"),
    )
    return out.withColumn("surname", surname(F.col("name")))


def composition(members: DataFrame) -> DataFrame:
    code = F.coalesce(F.nullif(F.col("party_code"), F.lit("")), F.col("party"))
    return members.groupBy("body_id", code.alias("code")).agg(F.count("*").alias("n"))


#: Rank of document types when a proposal's title is chosen.
TITLE_RANK = {"Beschlussvorlage": 0, "Vorlage": 1, "Antrag": 2, "Anfrage": 3}


def title_rank(doc_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in TITLE_RANK.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(doc_type, F.lit(""))), F.lit(9))


def lifecycle(links: DataFrame, files: DataFrame, meetings: DataFrame, agenda: DataFrame, votes: DataFrame) -> DataFrame:
    """Stations of proposals: a row for each (vorlage, meeting) with its documents and the votes on their items.

    ``links`` (file_id, vorlage, own).  Documents without a meeting make one station; dates that are
    unknown come last (``position``).
    """
    d = links.join(files.withColumnRenamed("id", "file_id"), "file_id")
    d = with_agenda(with_meeting(d, meetings), agenda)
    place = F.coalesce("meeting_id", F.lit("?"))
    doc = F.struct("file_id", "own", "label", "doc_type", "agenda_anchor", "submitters", "agenda_number", "agenda_title")
    stations = d.groupBy("vorlage", place.alias("station")).agg(
        F.min("meeting_id").alias("meeting_id"), F.min("meeting_date").alias("date"), F.min("body_id").alias("body_id"), F.min("body_name").alias("body_name"),
        F.min("meeting_title").alias("meeting_title"), F.array_sort(F.collect_list(doc)).alias("documents"),
    )
    items = d.where("meeting_id is not null and agenda_anchor is not null").select("vorlage", "meeting_id", "agenda_anchor").distinct()
    voted = items.join(votes.select("meeting_id", "agenda_anchor", "top_label", "result_text", "ja", "nein", "enthaltung", "source"), ["meeting_id", "agenda_anchor"])
    voted = voted.groupBy("vorlage", F.col("meeting_id").alias("station")).agg(F.array_sort(F.collect_list(F.struct("agenda_anchor", "top_label", "result_text", "ja", "nein", "enthaltung", "source"))).alias("votes"))
    return stations.join(voted, ["vorlage", "station"], "left")


def proposal_title(links: DataFrame, files: DataFrame) -> DataFrame:
    """(vorlage, title): label of the proposal's own document of the best rank, the earliest id of equal ones."""
    own = links.where("own").join(files.select(F.col("id").alias("file_id"), "label", "doc_type"), "file_id")
    return own.groupBy("vorlage").agg(F.min_by("label", F.struct(title_rank(F.col("doc_type")), F.col("file_id"))).alias("title"))


def latest_station(consultations: DataFrame, paper: str, meeting: str, date: str) -> DataFrame:
    """The station of a paper with the latest date, then the greatest meeting number; unknown dates are earliest."""
    from ..functions.links import tail_number

    rest = [c for c in consultations.columns if c != paper]
    order = F.struct(F.coalesce(F.col(date).cast("string"), F.lit("")), tail_number(F.col(meeting)))
    return consultations.groupBy(paper).agg(F.max_by(F.struct(*rest), order).alias("s")).select(paper, "s.*")


def carrier(files: DataFrame) -> DataFrame:
    """(meeting_id, file_id): the agenda or invitation of a meeting, else its first file under no item."""
    agenda = F.col("doc_type").isin("Tagesordnung", "Einladung")
    fit = files.where(agenda | F.col("agenda_anchor").isNull())
    return fit.groupBy("meeting_id").agg(F.min_by("id", F.struct(F.when(agenda, 0).otherwise(1), F.col("id"))).alias("file_id"))


def match_sessions(tickers: DataFrame, live: DataFrame) -> DataFrame:
    """Tickers (ticker, date, committee) with the live meeting (id, date, body_name) they belong to.

    One meeting on the date is it; of several, the first whose committee starts with the
    ticker's first 12 letters; otherwise none.
    Sessions are aggregated by date, and by date and prefix of the committee, before they meet tickers.
    """
    m = live.where("date is not null").select(F.col("id").alias("meeting_id"), F.col("date").alias("_d"), F.substring(F.coalesce("body_name", F.lit("")), 1, 12).alias("head"))
    m = m.groupBy("_d", "head").agg(F.count("meeting_id").alias("n"), F.min("meeting_id").alias("meeting_id"))
    days = m.groupBy("_d").agg(F.sum("n").alias("n"), F.min("meeting_id").alias("only"))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.length("head")), lambda k: F.substring("head", F.lit(1), k)))
    named = m.select("_d", cut.alias("_head"), "meeting_id").where("_head <> ''").groupBy(F.col("_d").alias("_d2"), "_head").agg(F.min("meeting_id").alias("named"))
    t = tickers.select("ticker", "date", "committee").distinct()
    j = t.join(days, t["date"] == F.col("_d"), "left").join(named, (t["date"] == F.col("_d2")) & (F.substring("committee", 1, 12) == F.col("_head")), "left")
    return j.select("ticker", "date", "committee", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("named")).alias("meeting_id"))


def group_with_rest(docs: DataFrame, anchors: DataFrame, meeting: str, anchor: str) -> DataFrame:
    """Documents with the item they are shown under; null for those whose anchor the agenda doesn't have."""
    a = anchors.select(F.col("meeting_id").alias("_m"), F.col("anchor").alias("shown_under")).distinct()
    return docs.join(a, (docs[meeting] == a["_m"]) & (docs[anchor] == a["shown_under"]), "left").drop("_m")
