"""What built-in functions cannot say: deep deletion in JSON, and new UUIDv7s. Arrow batches, no rows."""

from __future__ import annotations

import os
import time
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditmill.functions.redaction import redacted

#: A record's root names -> columns.
ROOT = {"id": "id", "tenantId": "tenant_id", "actorId": "actor_id", "action": "action", "entityId": "entity_id", "createdAt": "created_at", "ipAddress": "ip_address", "userAgent": "user_agent"}
BAGS = {"oldValues": "old_values", "newValues": "new_values", "metadata": "metadata"}


def _can_hold(text: Column, keys: list[str], paths: list[list[str]]) -> Column:
    """Whether text may hold one of these: it has the name, or an escape in which a name could be written."""
    names = [*keys, *(next((x for x in p if not x.isdecimal()), None) for p in paths)]
    # a path of numbers alone could lead into any array
    return F.lit(True) if None in names else reduce(Column.__or__, [text.contains(f'"{x}"') for x in names], text.contains("\\"))


def redactor(text: Column, keys: list[str], paths: list[list[str]]) -> Column:
    """text without these; only rows that can hold one go to Python, as Arrow buffers."""
    held = _can_hold(text, keys, paths)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return redacted(texts, keys, paths)

    return F.when(held, cut(F.when(held, text))).otherwise(text)


def redact(logs: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """logs without what paths name. A bare name goes from the root and, at any depth, from the three bags; a dotted path goes from the root.

    A bag that itself is named becomes null. Text that is not JSON stays, and what is left of JSON stays as it was written. A bare tenantId makes a record global."""
    keys = [p for p in paths if p and "." not in p]
    dotted = [p.split(".") for p in paths if "." in p]
    changed: dict[str, Column] = {c: F.lit(None).cast("string") for n, c in {**ROOT, **BAGS}.items() if n in keys}
    for name, c in BAGS.items():
        own = [p[1:] for p in dotted if p[0] == name]
        if c not in changed and (keys or own):
            changed[c] = redactor(F.col(c), keys, own)
    return logs.withColumns(changed) if changed else logs


def uuid7s(n: int, ms: int | None = None, last: tuple[int, int] = (0, 0)) -> tuple[list[str], tuple[int, int]]:
    """n ascending UUIDv7s, after the (millisecond, sequence) last; and the new last. A clock that goes back does not."""
    out = []
    at, seq = last
    now = time.time_ns() // 1_000_000 if ms is None else ms
    for _ in range(n):
        if now > at:
            at, seq = now, 0
        elif seq < 0xFFF:
            seq += 1
        else:
            at, seq = at + 1, 0
        tail = int.from_bytes(os.urandom(8), "big") & (1 << 62) - 1 | 1 << 63
        h = f"{at:012x}7{seq:03x}{tail:016x}"
        out.append(f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")
    return out, (at, seq)


@F.pandas_udf(StringType())
def new_uuid7(ids: pd.Series) -> pd.Series:
    """A new UUIDv7 for each row, ascending in a batch."""
    return pd.Series(uuid7s(len(ids))[0])


new_uuid7 = new_uuid7.asNondeterministic()
