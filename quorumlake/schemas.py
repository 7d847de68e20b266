"""Tables of the store and their value domains."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: Schemas as DDL; keys in ``KEYS``.
TABLES = {
    "bodies": "id string, name string, url string, first_seen timestamp, last_seen timestamp",
    "meetings": "id string, body_id string, body_name string, title string, date date, time string, location string, public boolean, url string, scraped_at timestamp",
    "members": "body_id string, person_id string, name string, party string, party_code string, role string, since string",
    "agenda_items": "meeting_id string, anchor string, first_seq long, number string, title string, public boolean",
    "files": "id string, url string, meeting_id string, agenda_anchor string, label string, doc_type string, filename string, sha256 string, size long, remote_modified string, local_path string, text_status string, enrich_status string, summary_de string, summary_en string, category string, topics array<string>, entities struct<people:array<string>,orgs:array<string>,locations:array<string>>, submitters array<string>, downloaded_at timestamp, enriched_at timestamp, first_seen timestamp, vorlage string, paper_type string, paper_reference string",
    "fulltexts": "id string, fulltext string",
    "votes": "id string, meeting_id string, agenda_anchor string, top_label string, result_text string, ja int, nein int, enthaltung int, members array<struct<name:string,vote:string>>, source string, image_url string, image_sha string, file_id string, parsed_at timestamp",
    "vote_parse_attempts": "file_id string, attempts int, last_attempt timestamp",
    "file_versions": "file_id string, sha256 string, id long, size long, remote_modified string, local_path string, downloaded_at timestamp, superseded_at timestamp",
    "file_vorlagen": "file_id string, vorlage string, own boolean",
    "meta": "key string, value string",
}

KEYS = {
    "bodies": ["id"], "meetings": ["id"], "members": ["body_id", "person_id"], "agenda_items": ["meeting_id", "anchor"], "files": ["id"], "fulltexts": ["id"],
    "votes": ["id"], "vote_parse_attempts": ["file_id"], "file_versions": ["file_id", "sha256"], "file_vorlagen": ["file_id", "vorlage"], "meta": ["key"],
}

# Domains of coded columns.
TEXT_STATUS = ("pending", "ok", "empty", "needs_ocr", "error", "missing")
ENRICH_STATUS = ("pending", "ok", "skipped", "error")
VOTE_SOURCES = ("live", "pdf")
CHOICES = ("ja", "nein", "enthaltung", "abwesend")


def schema(table: str) -> T.StructType:
    from pyspark.sql import SparkSession

    SparkSession.builder.getOrCreate()  # parsing DDL needs a session
    return _schema(TABLES[table])
