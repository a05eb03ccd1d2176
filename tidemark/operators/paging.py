"""Pages of a query's rows with their metadata."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows of a page, by default.
PAGE_SIZE = 10


@dataclass
class Page:
    """What was asked for of a page; fields that weren't stay None and cost no query."""

    rows: list[Row]
    pageSize: int
    currentPage: int
    hasNextPage: bool | None = None
    hasPreviousPage: bool | None = None
    nextOffset: int | None = None
    prevOffset: int | None = None
    totalRecords: int | None = None
    totalPages: int | None = None
    firstEventTime: Any = None
    lastEventTime: Any = None


def page(df: DataFrame, limit: int = PAGE_SIZE, offset: int = 0, fields: tuple[str, ...] = ("hasNextPage",), event_time: str | None = None) -> Page:
    """Rows ``offset`` to ``offset + limit`` of ``df``, which should be ordered.

    One row more than the page tells whether there is a next one. Totals and event times,
    if ``fields`` asks for them, come from a single aggregation.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    rows = df.offset(offset).limit(limit + 1).collect()
    more = len(rows) > limit
    out = Page(rows[:limit], limit, offset // limit)
    out.hasNextPage = more if {"hasNextPage", "nextOffset"} & set(fields) else None
    out.hasPreviousPage = offset > 0 if "hasPreviousPage" in fields else None
    out.nextOffset = offset + limit if more and "nextOffset" in fields else None
    out.prevOffset = max(0, offset - limit) if offset > 0 and "prevOffset" in fields else None
    asked = []
    if {"totalRecords", "totalPages"} & set(fields):
        asked.append(F.count("*").alias("n"))
    if event_time and {"firstEventTime", "lastEventTime"} & set(fields):
        asked += [F.min(event_time).alias("first"), F.max(event_time).alias("last")]
    if asked:
        found = df.agg(*asked).first().asDict()
        if "n" in found:
            out.totalRecords = found["n"] if "totalRecords" in fields else None
            out.totalPages = -(-found["n"] // limit) if "totalPages" in fields else None
        out.firstEventTime = found.get("first") if "firstEventTime" in fields else None
        out.lastEventTime = found.get("last") if "lastEventTime" in fields else None
    return out
