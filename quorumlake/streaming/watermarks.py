"""Incremental ingestion: watermarks that overlap and are held back by failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(df: DataFrame, modified: str, watermark) -> DataFrame:
    """Rows at or after the watermark; all of them while there is none."""
    return df if watermark is None else df.where(F.col(modified) >= F.lit(watermark))


def overlapped(started: Column, hours: int = 24) -> Column:
    """Where the next run resumes: some time before this one started, against skewed clocks."""
    return started - F.make_dt_interval(F.lit(0), F.lit(hours))


def next_watermark(outcomes: DataFrame, modified: str, failed: Column, started: Column, old: Column, hours: int = 24) -> DataFrame:
    """One row ``watermark``: the overlap point, or the oldest failure before it.

    A failure without a stamp keeps the old watermark, so that its window is walked again.
    """
    worst = F.min(F.when(failed & F.col(modified).isNotNull(), F.col(modified)))
    blank = F.max(F.when(failed & F.col(modified).isNull(), 1).otherwise(0)) == 1
    reached = overlapped(started, hours)
    held = F.least(reached, F.coalesce(worst, reached))
    return outcomes.agg(F.when(blank, F.least(old, held)).otherwise(held).alias("watermark"))


def recheck_window(df: DataFrame, date: str, today: Column, days: int = 21) -> DataFrame:
    return df.where(F.col(date).between(F.date_sub(today, days), today))


def live_now(df: DataFrame, start: Column, end: Column, now: Column) -> DataFrame:
    """Sessions under way, both ends included."""
    return df.where((start <= now) & (now <= end))


def without_deleted(df: DataFrame, deleted: Column) -> DataFrame:
    """Stubs of deleted objects are passed over; what is stored stays."""
    return df.where(~F.coalesce(deleted, F.lit(False)))


def quarantined(df: DataFrame, parsed: Column, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(readable rows, the others): a broken object is counted, not fatal."""
    marked = df.withColumn("_ok", parsed.isNotNull())
    return marked.where("_ok").drop("_ok"), marked.where("not _ok").select(*keep)


def first_deliveries(df: DataFrame, key: list[str], content: str, seq: str) -> DataFrame:
    """Polls that brought new content: an unchanged hash is skipped, a null one (a failed parse) never is."""
    from pyspark.sql import Window

    before = F.last(content, True).over(Window.partitionBy(*key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).where(F.col(content).isNull() | F.col("_before").isNull() | (F.col(content) != F.col("_before"))).drop("_before")
