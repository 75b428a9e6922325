"""Streams: records from files to the table, exactly once in effect; and a hash chain kept across batches."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditmill.functions.scalars import GENESIS, integrity_payload
from auditmill.plans.ingest import Limits, sanitised, split_by_tenant, with_request_context
from auditmill.sources.schema import COLUMNS, LOG


#: Columns of a request's headers, where records bring them.
HEADERS = "x_forwarded_for string, x_real_ip string, user_agent_header string, x_tenant_id string"


def source(spark: SparkSession, path: str, files_per_batch: int = 100, headers: bool = False) -> DataFrame:
    """A stream of JSON records below path; bags are JSON text. Files are taken as they come, so a backlog is worked off in bounded batches. headers: with HEADERS."""
    return spark.readStream.schema(f"{LOG}, {HEADERS}" if headers else LOG).option("maxFilesPerTrigger", files_per_batch).json(path)


def deliver(stream: DataFrame, insert: Callable[..., None], checkpoint: str, limits: Limits = Limits(), dead_letter: Callable[[DataFrame, Exception], None] | None = None,
            rejected: Callable[[DataFrame], None] | None = None, dedup_within: str | None = None, seconds: float | None = None, attempts: int = 3, backoff_ms: int = 1000, proxies: int | None = None,
            numbered: bool = False) -> StreamingQuery:
    """Cleaned records to insert(), batch by batch. proxies: a request's address, agent and tenant come from HEADERS, behind so many trusted proxies. A batch may be replayed after a crash: insert() is by id.

    A batch that insert() refuses `attempts` times goes to dead_letter(); without that, or if it fails too, the batch fails and stays in the checkpoint.
    numbered: insert() gets batch=(the query's id, the batch's number) too, by which a table tells a batch that it has: a replay adds nothing, to an AppendTable either.
    dedup_within bounds the state of an early dedup by event time. Without seconds, all that is there is worked off and the query ends."""
    if dedup_within:
        stream = stream.withColumn("_at", F.try_to_timestamp("created_at")).withWatermark("_at", dedup_within).dropDuplicatesWithinWatermark(["id"]).drop("_at")

    def batch(rows: DataFrame, number: int) -> None:
        # the query's id lies in the checkpoint, so it is the same after a restart
        own = {"batch": (rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number)} if numbered else {}
        good, bad = split_by_tenant(rows if proxies is None else with_request_context(rows, proxies), limits)
        clean = sanitised(good, limits).select(*COLUMNS).persist()
        try:
            for attempt in range(attempts):
                try:
                    insert(clean, **own)
                    break
                except Exception as e:  # noqa: BLE001 - any failure of the destination is retried, then dead-lettered
                    if attempt + 1 < attempts:
                        time.sleep(backoff_ms * 2**attempt / 1000)
                    elif dead_letter:
                        dead_letter(clean, e)
                    else:
                        raise
        finally:
            clean.unpersist()
        # after the good ones: if this fails the batch comes again, and they are there already
        if rejected and limits.require_tenant:
            rejected(bad)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def sealed(stream: DataFrame, chain: str = "tenant_id") -> DataFrame:
    """stream with prev_hash and content_hash; each chain's last hash is state, so that chains go on across batches and restarts.

    Records of a batch are chained by id. Those without a tenant are a chain of their own."""
    kept = [c for c in COLUMNS if c not in ("prev_hash", "content_hash")]
    held = stream.select(*kept, F.coalesce(F.concat(F.lit("of "), F.col(chain)), F.lit("")).alias("_chain"), integrity_payload().alias("_payload"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("id")
        tip = state.get[0] if state.exists else GENESIS
        prev, own = [], []
        for payload in rows["_payload"]:
            prev.append(tip)
            tip = hashlib.sha256(f"{tip}\n{payload}".encode()).hexdigest()
            own.append(tip)
        state.update((tip,))
        yield rows[kept].assign(prev_hash=prev, content_hash=own)[COLUMNS]

    return held.groupBy("_chain").applyInPandasWithState(run, LOG, "tip string", "append", "NoTimeout")
