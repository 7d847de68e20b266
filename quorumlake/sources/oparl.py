"""Council objects as JSON: a paginated collection as a Spark data source, dumps, and their tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import dates, links, text
from ..functions.links import with_parameters
from ..streaming.watermarks import quarantined, without_deleted


class CollectionError(RuntimeError):
    """A page failed; what was read so far must not move a watermark."""


class Collection:
    """A paginated collection, a page at a time.

    ``since`` is put into every link anew.  There is no limit of pages: a collection ends where a page names no next one, and a
    page that can't be read, holds no list of objects or was there before is an error, as whoever stops early must not
    move a watermark.
    """

    def __init__(self, url: str, fetch: Callable[[str], dict | None], since: str | None = None, page_size: int = 1000, fix: Callable[[str], str] = lambda u: u):
        self.fetch, self.since, self.fix = fetch, since, fix
        self.first = with_parameters(url, limit=page_size, modified_since=since)

    def pages(self) -> Iterator[list]:
        been, at = {self.first}, self.first
        while True:
            body = self.fetch(at)
            match body:
                case {"data": list(rows)}:
                    yield rows
                case _:
                    raise CollectionError(f"no list of objects at {at}")
            following = (body.get("links") or {}).get("next")
            if not following:
                return
            at = with_parameters(self.fix(following), modified_since=self.since)
            if at in been:
                raise CollectionError(f"{at} comes a second time")
            been.add(at)

    def objects(self) -> Iterator[dict]:
        return (o for rows in self.pages() for o in rows)


def fetch_json(url: str) -> dict | None:
    with urlopen(url, timeout=60) as r:
        try:
            return json.load(r)
        except ValueError:
            return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(u) for u in self.options["path"].split()]

    def read(self, partition):
        for o in Collection(partition.value, fetch_json, self.options.get("modified_since"), int(self.options.get("page_size", 1000))).objects():
            yield o.get("id"), o.get("modified"), bool(o.get("deleted")), json.dumps(o, ensure_ascii=False)


class CollectionSource(DataSource):
    """``spark.read.format("council-collection").load(urls)``; one task for each collection url."""

    @classmethod
    def name(cls):
        return "council-collection"

    def schema(self):
        return "id string, modified string, deleted boolean, object string"

    def reader(self, schema):
        return _Reader(dict(self.options))


# ---------------------------------------------------------------- dumps

FILE = "struct<fileName:string,name:string,downloadUrl:string,accessUrl:string,deleted:boolean>"
MEETING = f"id string, name string, start string, `end` string, deleted boolean, modified string, organization array<string>, location struct<room:string,description:string,streetAddress:string,deleted:boolean>, agendaItem array<struct<id:string,number:string,name:string,public:boolean,resolutionFile:{FILE},auxiliaryFile:array<{FILE}>>>, invitation {FILE}, resultsProtocol {FILE}, verbatimProtocol {FILE}, auxiliaryFile array<{FILE}>"
PAPER = f"id string, reference string, paperType string, deleted boolean, modified string, mainFile {FILE}, auxiliaryFile array<{FILE}>, consultation array<struct<meeting:string,agendaItem:string>>"


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, as dumps hold them, without deleted stubs; ``broken_objects`` has the files that can't be read."""
    rows, _ = _dump(spark, path, schema)
    return without_deleted(rows, F.col("deleted"))


def broken_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, record`` of each file that holds no object with an id: to be counted, not lost."""
    return _dump(spark, path, schema)[1]


def _dump(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    read = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "record").schema(f"{schema}, record string").json(path)
    rows = read.select("*", F.col("_metadata.file_name").alias("file"))
    good, broken = quarantined(rows, F.when(F.col("record").isNull(), F.col("id")), ["id", "file", "record"])
    return good.drop("file", "record"), broken.select("file", "record")


def fetch_objects(ids: DataFrame, url_col: str, fetch: Callable[[str], dict | None] = fetch_json) -> DataFrame:
    """``url, object, error`` for every link of a column, a task for each partition; what fails is a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            objects, errors = [], []
            for url in b.column(0).to_pylist():
                try:
                    found = fetch(url) if url else None
                    objects.append(json.dumps(found, ensure_ascii=False) if found is not None else None)
                    errors.append(None if found is not None else "no object")
                except OSError as e:
                    objects.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(objects, pa.string()), pa.array(errors, pa.string())], ["url", "object", "error"])

    return ids.select(F.col(url_col).alias("url")).mapInArrow(run, "url string, object string, error string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, fulltext) of ``<number>.txt`` files; ids without leading zeros, as the dump names them."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.txt$", 1).try_cast("long").alias("number"), F.col("value").alias("fulltext")).where("number is not null")


def sliced(ids: DataFrame, id_: str, n: int, newest: bool = True) -> DataFrame:
    key = F.col(id_).try_cast("long")
    return ids.orderBy(key.desc() if newest else key.asc(), id_).limit(n)


# ---------------------------------------------------------------- tables of objects


def meeting_rows(meetings: DataFrame) -> DataFrame:
    """Meetings as the store holds them; the committee is that of the first organization."""
    start, end = (F.try_to_timestamp(F.substring(F.col(c), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz") for c in ("start", "end"))
    loc = F.col("location")
    return meetings.select(
        links.tail(F.col("id")).alias("id"), links.body_id(F.try_element_at("organization", F.lit(1))).alias("body_id"), text.squash(F.col("name")).alias("title"), F.to_date(start).alias("date"),
        dates.german_window(start, end).alias("time"), F.when(~F.coalesce(loc["deleted"], F.lit(False)), text.first_filled(loc["room"], loc["description"], loc["streetAddress"])).alias("location"),
        text.meeting_public(F.col("name")).alias("public"), F.col("id").alias("url"), "modified",
    )


def agenda_rows(meetings: DataFrame) -> DataFrame:
    """Agenda items that have a number, in the order given."""
    a = meetings.select(links.tail(F.col("id")).alias("meeting_id"), F.posexplode("agendaItem").alias("first_seq", "a"))
    number = F.regexp_replace(F.trim("a.number"), r"\.$", "")
    return a.where(F.coalesce(number, F.lit("")) != "").select("meeting_id", F.concat(F.lit("top"), number).alias("anchor"), F.col("first_seq").cast("long").alias("first_seq"), number.alias("number"), text.squash(F.col("a.name")).alias("title"), F.col("a.public").alias("public"), F.col("a.id").alias("item"))


def _file_row(f, anchor):
    name = F.regexp_extract(F.coalesce(f["fileName"], F.lit("")), r"(?i)^(\d+)\.pdf$", 1)
    url = F.coalesce(F.when(f["downloadUrl"] != "", f["downloadUrl"]), f["accessUrl"])
    label = F.coalesce(text.blank_to_null(text.squash(f["name"])), f["fileName"])
    fine = f.isNotNull() & ~F.coalesce(f["deleted"], F.lit(False)) & (name != "") & url.isNotNull()
    return F.when(fine, F.struct(name.alias("id"), url.alias("url"), label.alias("label"), anchor.alias("agenda_anchor"), text.document_type(label).alias("doc_type"), f["fileName"].alias("filename")))


def meeting_files(meetings: DataFrame) -> DataFrame:
    """Files of meetings; the same file under an item wins over one that hangs under the meeting alone."""
    none = F.lit(None).cast("string")
    item = lambda a: F.concat(F.lit("top"), F.regexp_replace(F.trim(a["number"]), r"\.$", ""))
    own = lambda a: F.concat(F.array(_file_row(a["resolutionFile"], item(a))), F.transform(F.coalesce(a["auxiliaryFile"], F.array()), lambda f: _file_row(f, item(a))))
    under = F.flatten(F.transform(F.coalesce("agendaItem", F.array()), own))
    loose = F.concat(F.array(*(_file_row(F.col(c), none) for c in ("invitation", "resultsProtocol", "verbatimProtocol"))), F.transform(F.coalesce("auxiliaryFile", F.array()), lambda f: _file_row(f, none)))
    f = meetings.select(links.tail(F.col("id")).alias("meeting_id"), F.posexplode(F.array_compact(F.concat(under, loose))).alias("n", "f")).select("meeting_id", "n", "f.*")
    rest = ["url", "label", "agenda_anchor", "doc_type", "filename"]
    return f.groupBy("meeting_id", "id").agg(F.min_by(F.struct(*rest), F.struct(F.col("agenda_anchor").isNull(), F.col("n"))).alias("f")).select("id", "meeting_id", "f.*")


def paper_stations(papers: DataFrame, agenda: DataFrame, meetings: DataFrame) -> DataFrame:
    """(paper, meeting_id, anchor, date) of each consultation; the anchor counts only if its item is of that meeting."""
    c = papers.select(links.tail(F.col("id")).alias("paper"), text.reference_base(F.col("reference")).alias("vorlage"), F.explode("consultation").alias("c"))
    c = c.select("paper", "vorlage", links.tail(F.col("c.meeting")).alias("meeting_id"), F.col("c.agendaItem").alias("item"))
    a = agenda.select("item", F.col("meeting_id").alias("_m"), "anchor")
    m = meetings.select(F.col("id").alias("meeting_id"), "date")
    return c.join(a, "item", "left").join(m, "meeting_id", "left").select("paper", "vorlage", "meeting_id", F.when(F.col("_m") == F.col("meeting_id"), F.col("anchor")).alias("anchor"), "date")
