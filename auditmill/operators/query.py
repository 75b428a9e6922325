"""Filtered, newest-first pages of the audit table, by keyset."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from auditmill.functions.scalars import month

PAGE, MAX_PAGE = 50, 500
BAGS = ("old_values", "new_values", "metadata")


@dataclass(frozen=True)
class Filters:
    """All are optional; an empty one is none. Dates are inclusive."""

    action: str | None = None
    actor_id: str | None = None
    entity_id: str | None = None
    start: str | None = None
    end: str | None = None


def predicates(tenant: str | None, f: Filters = Filters(), cursor: str | None = None, as_time: bool = False, partitioned: bool = False) -> list[Column]:
    """What a row must fulfil. Dates are compared as text, or as times. A null tenant is any.

    partitioned: the table has created_month, whose bounds follow from the dates, so that other months are not read."""
    out = [F.col("tenant_id") == tenant] if tenant is not None else []
    out += [F.col(c) == v for c in ("action", "actor_id", "entity_id") if (v := getattr(f, c))]
    at = F.try_to_timestamp("created_at") if as_time else F.col("created_at")
    for value, op in ((f.start, "ge"), (f.end, "le")):
        if value:
            bound = F.try_to_timestamp(F.lit(value)) if as_time else F.lit(value)
            out.append(at >= bound if op == "ge" else at <= bound)
            if partitioned and not as_time and len(value) >= 7:
                own = month(F.lit(value))
                out.append(F.col("created_month") >= own if op == "ge" else F.col("created_month") <= own)
    return out + ([F.col("id") < cursor] if cursor else [])


def filtered(logs: DataFrame, *args, **options) -> DataFrame:
    for p in predicates(*args, **options):
        logs = logs.where(p)
    return logs


def clamp(limit: float | None, most: int = MAX_PAGE) -> int:
    """Rows in a page: 50 unless asked for, 1 at least."""
    asked = limit if isinstance(limit, (int, float)) and math.isfinite(limit) else PAGE
    return int(min(max(1, asked), most))


def page(logs: DataFrame, tenant: str | None, f: Filters = Filters(), cursor: str | None = None, limit: float | None = None, most: int = MAX_PAGE, **options) -> DataFrame:
    """One page's rows and, where there are more, one row beyond."""
    return filtered(logs, tenant, f, cursor, **options).orderBy(F.desc("id")).limit(clamp(limit, most) + 1)


def collected(ahead: DataFrame, limit: float | None = None, most: int = MAX_PAGE) -> tuple[list[Row], str | None]:
    """A page's rows and the next cursor, of page()'s result with the same limits."""
    n = clamp(limit, most)
    rows = ahead.collect()
    return rows[:n], rows[n - 1].id if len(rows) > n else None


def parsed(row: Row) -> dict:
    """A page's row with its bags as values; what is no JSON, or empty, is None."""
    out = row.asDict()
    for c in BAGS:
        try:
            out[c] = json.loads(out[c]) if out[c] else None
        except ValueError:
            out[c] = None
    return out


def with_parsed_bags(logs: DataFrame) -> DataFrame:
    """logs with old_values, new_values and metadata as variants; what is no JSON is null."""
    return logs.withColumns({c: F.try_parse_json(F.nullif(F.col(c), F.lit(""))) for c in BAGS})
