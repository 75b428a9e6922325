"""Batches by size or by time for each tenant, as a stream's state: a tenant's records wait until there are enough, or the first has waited long enough."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from auditmill.sources.schema import COLUMNS, LOG

#: Records of a batch and milliseconds that a record waits at most.
SIZE, WAIT_MS = 100, 5_000
SCHEMA = f"queue string, batch_no long, cause string, {LOG}"


def batched(stream: DataFrame, size: int = SIZE, wait_ms: int = WAIT_MS, tenant: str = "tenant_id") -> DataFrame:
    """queue, batch_no, cause (size or time) and the columns of each record of the stream, once its batch is due.

    Whole batches of `size` records of a tenant go as they fill, in the order of their ids within what came at one time. The rest waits as state until `wait_ms` of processing time
    after the first of them came, and then goes as it is. So state holds fewer than `size` records a tenant, and nothing after a batch by time: the tenant's
    state is then only the number of its batches. Records without a tenant are a queue of their own. State outlives restarts with the checkpoint."""
    queue = F.coalesce(F.concat(F.lit("of "), F.col(tenant)), F.lit(""))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, n, due = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        now = state.getCurrentProcessingTimeMs()
        came: list[list] = []
        if not state.hasTimedOut:
            for part in parts:
                came += part[COLUMNS].astype(object).where(part[COLUMNS].notna(), None).values.tolist()
        waits = bool(held)
        held += sorted(came, key=lambda r: (r[0] is not None, r[0]))
        out = []
        while len(held) >= size:
            out.append((n, "size", held[:size]))
            held, n, waits = held[size:], n + 1, False
        if held and waits and now >= due:
            out.append((n, "time", held))
            held, n = [], n + 1
        if held:
            due = due if waits else now + wait_ms
            state.setTimeoutDuration(max(1, math.ceil(due - now)))
        state.update((json.dumps(held), n, due if held else 0))
        rows = [[key[0], no, cause, *r] for no, cause, own in out for r in own]
        yield pd.DataFrame(rows, columns=["queue", "batch_no", "cause", *COLUMNS])

    return stream.select(queue.alias("_queue"), *COLUMNS).groupBy("_queue").applyInPandasWithState(run, SCHEMA, "held string, batches long, due long", "append", GroupStateTimeout.ProcessingTimeTimeout)
