"""Boundaries to programs and models outside the engine: each is a function from a batch of inputs
to results, run over Arrow batches, whose failures become statuses instead of failed jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CAPS, text_status
from ..functions.votes import enrichment, vote_of


def extract_texts(files: DataFrame, extract: Callable[[bytes], str], id_: str = "path", content: str = "content") -> DataFrame:
    """``id, fulltext, text_status`` of binary files, as ``spark.read.format("binaryFile")`` gives them."""
    most = CAPS["stored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, failed = [], []
            for x in b.column(1):
                try:
                    out.append(extract(x.as_py() or b"")[:most])
                    failed.append(False)
                except Exception:  # noqa: BLE001  whatever the program does is this file's status
                    out.append(None)
                    failed.append(True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(failed, pa.bool_())], ["id", "fulltext", "failed"])

    got = files.select(F.col(id_).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "id string, fulltext string, failed boolean")
    return got.select("id", "fulltext", text_status(F.col("fulltext"), F.col("failed")).alias("text_status"))


def ask(rows: DataFrame, id_: str, prompt: str, model: Callable[[list[str]], list[str | None]], size: int = 25) -> DataFrame:
    """``id, reply`` from a model that answers batches of prompts; a batch that fails gives null replies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts, replies = b.column(1).to_pylist(), []
            for i in range(0, len(prompts), size):
                part = prompts[i : i + size]
                try:
                    replies += list(model(part))
                except Exception:  # noqa: BLE001
                    replies += [None] * len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(replies, pa.string())], ["id", "reply"])

    return rows.select(F.col(id_).cast("string"), F.col(prompt)).mapInArrow(run, "id string, reply string")


def enriched(replies: DataFrame) -> DataFrame:
    """``id, enrich_status`` and the normalised fields of replies."""
    e = replies.select("id", enrichment(F.col("reply")).alias("e"))
    return e.select("id", F.when(F.col("e").isNull(), "error").otherwise("ok").alias("enrich_status"), "e.*")


def read_votes(replies: DataFrame) -> DataFrame:
    """``id, ja, nein, enthaltung, members``; all null where a reply can't be used."""
    v = replies.select("id", vote_of(F.col("reply")).alias("v"))
    return v.select("id", "v.ja", "v.nein", "v.enthaltung", "v.members")
