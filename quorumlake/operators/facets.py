"""Conjunctive facets, work queues and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ascii_ci


def facet_filter(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet all conditions given; a null outcome doesn't meet one."""
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def equal(c: Column, value) -> Column | None:
    """No condition for a value that is unset."""
    return c == value if value else None


def name_or_id(name: Column, id_: Column, value: str | None) -> Column | None:
    return (name == value) | (id_ == value) if value else None


def dates(c: Column, start, end) -> list[Column]:
    given = lambda x: isinstance(x, Column) or bool(x)
    return [*([c >= F.lit(start)] if given(start) else []), *([c <= F.lit(end)] if given(end) else [])]


def flag(c: Column, value: bool | None) -> Column | None:
    return c == F.lit(value) if value is not None else None


def parse_flag(text: str | None) -> bool | None:
    """As an HTTP argument: nothing or ``all`` sets no filter."""
    if text is None or text in ("", "all"):
        return None
    return text.lower() in ("1", "true", "public", "öffentlich")


def has_tag(c: Column, value: str | None) -> Column | None:
    return F.array_contains(c, value) if value else None


def any_contains(cs: list[Column], needle: str | None) -> Column | None:
    """A-Z ignore case; null columns contain nothing."""
    if not needle:
        return None
    out = F.lit(False)
    for c in cs:
        out = out | contains_ascii_ci(F.coalesce(c, F.lit("")), needle)
    return out


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a totally ordered table; Spark keeps only the top rows of each task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def checked_bounds(limit: int, offset: int, most: int) -> tuple[int, int]:
    """For HTTP: refuses what is out of range."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset at least 0")
    return limit, offset


def clamped_bounds(limit: int, offset: int, most: int) -> tuple[int, int]:
    """For tools: clamps silently."""
    return max(1, min(limit, most)), max(0, offset)
