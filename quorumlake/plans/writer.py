"""Writers of the store: arrivals of every kind folded into its tables.

A table is folded from its current rows and what came in, written whole beside itself, and takes the table's
place by a rename once it is complete; a run that fails before that changes nothing.  Replaying arrivals gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import merge
from ..schemas import schema
from ..sources import oparl, pages
from .api import Store


class Writer:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        jvm = self.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(store.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self, name: str) -> DataFrame:
        """The table as it is; empty before its first commit."""
        if self._fs.exists(self._path(f"{self.store.folder}/{name}")):
            return self.store.table(name)
        return self.spark.createDataFrame([], schema(name))

    def commit(self, name: str, rows: DataFrame) -> None:
        """Replaces a table by rows that may be computed from it."""
        shape = schema(name)
        fresh, old = (f"{self.store.folder}/.{name}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in shape)).write.parquet(fresh)
        place = self._path(f"{self.store.folder}/{name}")
        if self._fs.exists(place):
            self._fs.rename(place, self._path(old))
        if not self._fs.rename(self._path(fresh), place):
            self._fs.rename(self._path(old), place)
            raise RuntimeError(f"{name} could not be replaced")
        self._fs.delete(self._path(old), True)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with all columns of a table, null where they have none."""
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))

    def _after(self, name: str, rows: DataFrame, seq: str | None = None) -> DataFrame:
        """Current rows, then arrivals in order of ``seq``."""
        came = rows.withColumn("_order", F.col(seq).cast("long") if seq else F.lit(0).cast("long"))
        shaped = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)]
        return self.current(name).withColumn("seq", F.lit(-(1 << 62))).unionByName(came.select(*shaped, F.col("_order").alias("seq")))

    def meetings(self, rows: DataFrame) -> None:
        """A meeting's last description counts; its link stays the first."""
        self.commit("meetings", merge.latest_wins(self._after("meetings", rows), ["id"], "seq", first_only=("url",)))

    def agenda(self, rows: DataFrame) -> None:
        """The agenda of each meeting that ``rows`` name is replaced whole; a meeting without items there keeps its own."""
        self.commit("agenda_items", merge.snapshot_replace(self.current("agenda_items"), self._shaped("agenda_items", rows), ["meeting_id"]))

    def members(self, rows: DataFrame) -> None:
        """The roster of each body that ``rows`` name is replaced whole."""
        self.commit("members", merge.snapshot_replace(self.current("members"), self._shaped("members", rows), ["body_id"]))

    def bodies(self, rows: DataFrame, names: bool, now: Column) -> None:
        """Committees seen now.  Only sources with ``names`` rename one that is known; others say that it was seen."""
        came = rows.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("url").alias("_url") if "url" in rows.columns else F.lit(None).cast("string").alias("_url"))
        came = came.groupBy("_id").agg(F.max("_name").alias("_name"), F.max("_url").alias("_url"))
        j = self.current("bodies").join(came, F.col("id") == F.col("_id"), "full")
        seen, name = F.when(F.col("_id").isNotNull(), now), (F.coalesce("_name", "name") if names else F.coalesce("name", "_name"))
        self.commit("bodies", j.select(F.coalesce("id", "_id").alias("id"), name.alias("name"), F.coalesce("url", "_url").alias("url"), F.coalesce("first_seen", seen).alias("first_seen"), F.coalesce(seen, "last_seen").alias("last_seen")))

    def votes(self, arrivals: DataFrame, seq: str = "seq") -> None:
        """Votes by precedence, folded from the current rows and the arrivals alone."""
        self.commit("votes", self._shaped("votes", merge.merge_votes(self._after("votes", arrivals, seq), "seq")))

    def vorlagen(self, rows: DataFrame) -> None:
        """Proposal numbers of each file that ``rows`` name are replaced; a null number clears them."""
        self.commit("file_vorlagen", merge.replace_per_key(self.current("file_vorlagen"), self._shaped("file_vorlagen", rows), "file_id"))

    def files(self, rows: DataFrame, now: Column, readable: Column | None = None) -> dict[str, int]:
        """Files that were looked at, by the rules of ``classify_changes``; superseded contents join the versions once,
        numbered by a hash of file and content.  Counts by change."""
        prior, versions = self.current("files"), self.current("file_versions")
        found = merge.classify_changes(rows, prior, ["id"], "size", "remote_modified", "sha256", readable)
        files, old = merge.apply_changes(prior, _with_missing(found, merge.ASSOCIATION + merge.CONTENT))
        counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}  # at most five
        archived = old.join(versions.select("file_id", "sha256"), ["file_id", "sha256"], "left_anti").withColumn("superseded_at", now).withColumn("id", F.xxhash64("file_id", "sha256"))
        self.commit("file_versions", versions.unionByName(self._shaped("file_versions", archived)))
        self.commit("files", files)
        return counts

    def seed(self, dump: DataFrame) -> None:
        """Files of a bulk dump (``merge.seed_files``)."""
        self.commit("files", merge.seed_files(self.current("files"), _with_missing(dump, merge.ASSOCIATION)))

    def refresh(self, meeting_id: str, url: str, fetch: Callable[[str], object], domain: str = "") -> int:
        """Reads one meeting anew, from its page or its object, and folds it into the store.  The number of its agenda items."""
        body = fetch(url)
        if body is None:
            return 0
        if self.store.refresher(meeting_id) == "pages":
            page = self.spark.createDataFrame([(meeting_id, url, str(body))], "id string, url string, html string")
            m = pages.parse_meetings(page, domain)
            agenda = m.select(F.col("id").alias("meeting_id"), F.posexplode("agenda").alias("first_seq", "a")).select("meeting_id", "first_seq", "a.*")
            m = m.withColumn("date", F.to_date("date"))
        else:
            import json

            m0 = self.spark.createDataFrame([(json.dumps(body),)], "o string").select(F.from_json("o", oparl.MEETING).alias("o")).select("o.*")
            m, agenda = oparl.meeting_rows(m0), oparl.agenda_rows(m0)
        self.meetings(m)
        self.agenda(agenda)
        return agenda.count()


def _with_missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with null columns of the files table where they have none of that name."""
    kinds = {f.name: f.dataType for f in schema("files")}
    return rows.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns if c not in rows.columns})
