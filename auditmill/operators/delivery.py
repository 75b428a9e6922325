"""Dedup, journal, admission, dead letters, retention: the dataflow between producers and the audit table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.functions.scalars import GLOBAL, safe_json
from auditmill.operators.scans import running


# dedup

def first_write(logs: DataFrame, seq: str) -> DataFrame:
    """Of rows with one id, the first by seq. Each task keeps one row of an id before the shuffle (WindowGroupLimit)."""
    return logs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(seq))).where("_n = 1").drop("_n")


def last_write(logs: DataFrame, seq: str) -> DataFrame:
    """Of rows with one tenant and id, the last by seq; likewise."""
    return logs.withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id", "id").orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def insert_if_absent(new: DataFrame, existing: DataFrame, seq: str) -> DataFrame:
    """Rows of new that an insert adds: first writes whose id isn't there."""
    return first_write(new, seq).join(existing.select("id"), "id", "left_anti")


# journal

def pending(journal: DataFrame, acks: DataFrame) -> DataFrame:
    """Journal rows whose id has no ack."""
    return journal.join(acks.select("id"), "id", "left_anti")


def recover(rows: DataFrame, order: tuple[str, ...], group: str, max_logs: int | None = None, max_bytes: float | None = None, size: Column | None = None) -> DataFrame:
    """The first rows by group and order, max_logs at most and of max_bytes at most together; the first that does not fit ends them.

    A negative bound is 0, one that isn't finite is none."""
    if max_logs is not None:
        rows = rows.orderBy(group, *order).limit(max(0, max_logs))
    if max_bytes is not None and math.isfinite(max_bytes):
        rows = running(rows, group, order, size, "_bytes").where(F.col("_bytes") <= max(0, int(max_bytes))).drop("_bytes")
    return rows


def segment_bytes(journal: DataFrame) -> DataFrame:
    """Bytes of all segments, newlines included."""
    return journal.agg(F.coalesce(F.sum(F.octet_length("payload") + 1), F.lit(0)).alias("bytes"))


def compacted(journal: DataFrame, acks: DataFrame) -> DataFrame:
    """What a compaction keeps: each record without an ack, once, with the number that it gets in the new segment."""
    return running(pending(journal, acks).dropDuplicates(["id"]), "segment", ("seq",), F.lit(1).cast("long"), "place")


def row_journal(rows: DataFrame, limit: int, schema: str) -> DataFrame:
    """log and truncated of the first `limit` rows (id, payload, acked, created_ms) without an ack, by time and id; truncated tells that there are more.

    A payload that is no JSON is skipped, but counts."""
    ahead = rows.where("acked = 0").orderBy("created_ms", "id").limit(limit + 1)
    counted = ahead.withColumns({"_n": F.row_number().over(Window.orderBy("created_ms", "id")), "_all": F.count("*").over(Window.partitionBy())})
    read = counted.where(F.col("_n") <= limit).select("id", F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("log"), safe_json(F.col("payload")).alias("_ok"), (F.col("_all") > limit).alias("truncated"))
    return read.where("_ok is not null").drop("_ok")


def max_segment(names: DataFrame) -> DataFrame:
    """The largest number of a segment's name (name); 0 if there is none."""
    return names.agg(F.coalesce(F.max(F.regexp_extract("name", r"^segment-([0-9]+)\.ndjson$", 1).try_cast("long")), F.lit(0)).alias("segment"))


# admission

def queue_key() -> Column:
    return F.coalesce("tenant_id", F.lit(GLOBAL))


def admission_wave(rows: DataFrame, seq: str, per_tenant: int, total: int, tenants: int) -> DataFrame:
    """rows with `admitted`: per_tenant first rows of each tenant, of the `tenants` tenants seen first, and `total` rows at most."""
    keyed = rows.withColumns({"queue": queue_key()})
    order = Window.orderBy("first_seen")
    seen = keyed.groupBy("queue").agg(F.min(seq).alias("first_seen"), F.count("*").alias("n"))
    taken = seen.withColumn("rank", F.row_number().over(order)).withColumn("may", F.when(F.col("rank") <= tenants, F.least("n", F.lit(per_tenant))).otherwise(0))
    # one row a tenant: where its rows begin among all that may be admitted
    caps = taken.select("queue", "rank", "may", (F.sum("may").over(Window.orderBy("rank")) - F.col("may")).alias("before"))
    own = keyed.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(seq)))
    return own.join(caps, "queue").withColumn("admitted", (F.col("place") <= F.col("may")) & (F.col("before") + F.col("place") <= total)).select(*rows.columns, "queue", "rank", "place", "admitted")


def chunks(rows: DataFrame, seq: str, size: int) -> DataFrame:
    """rows with batch_no: each tenant's queue in batches of size."""
    n = F.row_number().over(Window.partitionBy(queue_key()).orderBy(seq))
    return rows.withColumn("batch_no", F.floor((n - 1) / size).cast("long"))


def by_tenant(rows: DataFrame, seq: str) -> DataFrame:
    """queue, first_seen, ids (by seq) of each tenant; a queue's rows are one row, so rows are what one flush takes."""
    return rows.groupBy(queue_key().alias("queue")).agg(F.min(seq).alias("first_seen"), F.transform(F.array_sort(F.collect_list(F.struct(seq, "id"))), lambda x: x["id"]).alias("ids"))


def occupancy(queued: DataFrame, reserved: DataFrame) -> DataFrame:
    """queue, n: records queued and places reserved (tenant_id) of each tenant."""
    return queued.select(queue_key().alias("queue")).union(reserved.select(queue_key().alias("queue"))).groupBy("queue").agg(F.count("*").alias("n"))


def backpressure(rows: DataFrame, seq: str, cap: int, policy: str) -> DataFrame:
    """rows with `fate` where each tenant's queue takes cap rows: the last that fit are admitted; others are spilled to the dead letters ("dlq": the queue
    goes whole each time it is full) or dropped ("drop": what comes when it is full goes)."""
    if policy not in ("dlq", "drop"):
        raise ValueError(f"no policy {policy}")
    own = Window.partitionBy(queue_key())
    n = F.row_number().over(own.orderBy(seq))
    if policy == "drop":
        return rows.withColumn("fate", F.when(n <= cap, "admitted").otherwise("dropped"))
    return rows.withColumn("fate", F.when(F.floor((n - 1) / cap) == F.floor((F.count("*").over(own) - 1) / cap), "admitted").otherwise("spilled"))


def backlog(deferred: DataFrame, waiting: DataFrame, seq: str) -> DataFrame:
    """Both with `turn` (deferred, n): what was deferred goes before what waits, each by seq. They order the whole; no row is numbered in one task."""
    turn = lambda k: F.struct(F.lit(k).alias("part"), F.col(seq).alias("seq"))
    return deferred.withColumn("turn", turn(0)).unionByName(waiting.withColumn("turn", turn(1)))


def fair_order(rows: DataFrame, seq: str) -> DataFrame:
    """queue, n, first_seen, turn: tenants by queue length, longest first, then by first row."""
    n = rows.groupBy(queue_key().alias("queue")).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))
    return n.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")))


def victim(rows: DataFrame, seq: str, admitting: str) -> DataFrame:
    """The longest queue but that of the admitting tenant; its own if there is no other."""
    return fair_order(rows, seq).orderBy(F.col("queue") == admitting, "turn").limit(1).select("queue", "n")


def spill(rows: DataFrame, seq: str, admitting: str, cap: int, coming: int = 1) -> DataFrame:
    """Queues that are spilled for `coming` rows to fit under cap: the longest of others first, the admitting one's last."""
    n = fair_order(rows, seq)
    order = Window.orderBy(F.col("queue") == admitting, "turn")
    freed = n.withColumn("before", F.sum("n").over(order) - F.col("n")).crossJoin(n.agg(F.sum("n").alias("all")))
    return freed.where(F.col("all") + coming - F.col("before") > cap).select("queue", "n")


def queue_stats(rows: DataFrame) -> DataFrame:
    """queued, tenants."""
    n = rows.groupBy(queue_key().alias("queue")).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queued"), F.count("*").alias("tenants"))


# dead letters

def latest(transitions: DataFrame) -> DataFrame:
    """id, state, attempts of each batch by its transitions (id, n, state, attempts); deleted ones are gone."""
    return transitions.groupBy("id").agg(F.max_by(F.struct("state", "attempts"), "n").alias("x")).select("id", "x.state", "x.attempts").where("state <> 'deleted'")


def state_collisions(transitions: DataFrame) -> DataFrame:
    """id, states of batches whose last changes, of one time, disagree."""
    last = transitions.groupBy("id").agg(F.max("n").alias("n"))
    return transitions.join(last, ["id", "n"]).groupBy("id").agg(F.array_sort(F.collect_set("state")).alias("states")).where(F.size("states") > 1)


def listing(dlq: DataFrame, pending: bool = True, processing: bool = False, dead: bool = False) -> DataFrame:
    """id, state, kind, tenant_id, attempts, log_count of batches in these states, by id."""
    states = [s for s, on in (("pending", pending), ("processing", processing), ("dead", dead)) if on]
    return dlq.where(F.col("state").isin(*states) if states else F.lit(False)).select("id", "state", F.col("state").alias("kind"), "tenant_id", "attempts", F.coalesce(F.size("logs"), F.lit(0)).alias("log_count")).orderBy("id")


def counts(dlq: DataFrame, unacked: DataFrame) -> DataFrame:
    """pending, processing, dead, live (what counts against capacity), and whether there is work."""
    of = lambda s: F.count_if(F.col("state") == s)
    n = dlq.agg(of("pending").alias("pending"), of("processing").alias("processing"), of("dead").alias("dead"))
    j = unacked.agg(F.count("*").alias("journal"))
    return n.crossJoin(j).select("*", (F.col("pending") + F.col("processing")).alias("live"), (F.col("journal") * 256).alias("approx_bytes"), (F.col("pending") + F.col("processing") + F.col("journal") > 0).alias("has_work"))


def claim_next(dlq: DataFrame, n: int = 1) -> DataFrame:
    """The pending batches that are claimed next: oldest first."""
    return dlq.where("state = 'pending'").orderBy("created_ms", "id").limit(n)


def poisoned(dlq: DataFrame, max_attempts: int = 10) -> DataFrame:
    """Claimed batches that become dead: tried max_attempts times, or without logs."""
    return dlq.where((F.col("state") == "processing") & ((F.col("attempts") >= max_attempts) | F.col("logs").isNull() | (F.size("logs") == 0)))


# retention

def oldest_expired(logs: DataFrame, cutoff: str, n: int) -> DataFrame:
    """The rows of one batch of a deletion in batches: n expired ones at most, oldest first by id."""
    return logs.where(expired(cutoff)).orderBy("id").limit(n)


def expired(cutoff: str) -> Column:
    return F.col("created_at") < cutoff


def expired_months(logs: DataFrame, cutoff: str) -> DataFrame:
    """Months that lie wholly before cutoff's."""
    return logs.select(F.concat(F.substring("created_at", 1, 4), F.substring("created_at", 6, 2)).alias("m")).where(F.col("m").rlike("^[0-9]{6}$")).select(F.col("m").cast("int").alias("created_month")).where(F.col("created_month") < int(cutoff[:4] + cutoff[5:7])).distinct()


def tenants_to_prune(*sets: DataFrame) -> DataFrame:
    """Distinct tenants of all sets, without null and empty ones."""
    out = sets[0].select("tenant_id")
    for s in sets[1:]:
        out = out.union(s.select("tenant_id"))
    return out.where("tenant_id <> ''").distinct()
