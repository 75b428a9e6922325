"""The journal, a log of small files that are only ever added; and the dead letters, batches with a log of their states."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions.scalars import encrypt
from auditmill.operators import delivery
from auditmill.sources import files
from auditmill.sources.schema import COLUMNS, DLQ, LOG
from auditmill.sources.hadoop import Files

#: Column -> name in journal and dead-letter files; the bags are JSON there.
NAMES = {c: "".join(p if i == 0 else p.capitalize() for i, p in enumerate(c.split("_"))) for c in COLUMNS}
BAGS = ("old_values", "new_values", "metadata")


class JournalFull(RuntimeError):
    pass


def line(record: dict) -> str:
    """A record as a line of a journal file. A bag's text is part of the JSON as it is."""
    parts = [f"{json.dumps(n)}:{record[c] if c in BAGS else json.dumps(record[c], ensure_ascii=False)}" for c, n in NAMES.items() if record.get(c) is not None]
    return f'{{"id":{json.dumps(record["id"])},"log":{{{",".join(parts)}}}}}'


class Journal:
    """Segments of records, and files of the ids that are delivered. One writer at a time.

    append() returns once the records are stored. Records count as pending until they are acked; compact() writes pending ones anew and drops
    the rest. With a key, lines are encrypted. Threads of the writer may share it."""

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = 64 << 20, ack_files: int = 256, key: bytes | None = None):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.max_bytes, self.ack_files, self.key = max_bytes, ack_files, key
        self._bytes = sum(self.files.sizes("segments").values())
        self._next = self.max_segment() + 1
        self._lock = threading.RLock()

    def segments(self) -> list[str]:
        return [n for n in self.files.names("segments") if n.endswith(".ndjson")]

    def max_segment(self) -> int:
        return max((int(n[:20]) for n in (*self.segments(), *self.files.names("acks")) if n[:20].isdigit()), default=0)

    def bytes(self) -> int:
        return self._bytes

    def _number(self) -> str:
        self._next += 1
        return f"{self._next:020d}"

    def _sealed(self, lines: list[str]) -> list[str]:
        if not self.key:
            return lines
        made = self.spark.createDataFrame([(i, x, os.urandom(12)) for i, x in enumerate(lines)], "i int, line string, iv binary")
        return [r.line for r in made.select("i", encrypt(F.col("line"), F.lit(self.key), F.col("iv")).alias("line")).orderBy("i").collect()]

    def append(self, records: list[dict]) -> None:
        """Store records in a segment of their own; all or none. JournalFull if max_bytes would be passed."""
        if not records:
            return
        text = "".join(x + "\n" for x in self._sealed([line(r) for r in records]))
        size = len(text.encode())
        with self._lock:
            if self._bytes + size > self.max_bytes:
                raise JournalFull(f"the journal holds {self._bytes} bytes and takes {self.max_bytes}")
            self.files.write(f"segments/{self._number()}.ndjson", text)
            self._bytes += size

    def ack(self, ids: list[str]) -> None:
        """These records are delivered. Many files of acks make the journal compact itself."""
        with self._lock:
            if ids:
                self.files.write(f"acks/{self._number()}.txt", "".join(i + "\n" for i in ids))
                if len(self.files.names("acks")) >= self.ack_files:
                    self.compact()

    def acks(self) -> DataFrame:
        return files.acks(self.spark, f"{self.path}/acks") if self.files.names("acks") else self.spark.createDataFrame([], "id string")

    def records(self) -> DataFrame:
        """segment and the columns of each readable record."""
        if not self.segments():
            return self.spark.createDataFrame([], f"segment string, {LOG}")
        return files.journal(self.spark, f"{self.path}/segments", self.key).select("segment", "log.*")

    def pending(self) -> DataFrame:
        return delivery.pending(self.records(), self.acks())

    def recover(self, max_logs: int | None = None, max_bytes: float | None = None) -> tuple[list[dict], bool]:
        """The oldest pending records within these bounds, and whether there are more."""
        rows = self.pending().dropDuplicates(["id"])
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in COLUMNS), F.lit(0))
        got = delivery.recover(rows, ("id",), "segment", max_logs, max_bytes, size).select("segment", *COLUMNS).collect()
        got = [{c: r[c] for c in COLUMNS} for r in sorted(got, key=lambda r: (r.segment, r.id))]
        bounded = max_logs is not None or max_bytes is not None
        return got, bounded and rows.limit(len(got) + 1).count() > len(got)

    def compact(self) -> None:
        """Pending records in one segment; nothing else. What is not readable goes."""
        old, acked = self.segments(), self.files.names("acks")
        if not acked:
            return
        left = self.recover()[0]
        if left:
            self.files.write(f"segments/{self._number()}.ndjson", "".join(x + "\n" for x in self._sealed([line(r) for r in left])))
        # records that are twice there for a moment have one id
        for n in old:
            self.files.drop("segments", n)
        for n in acked:
            self.files.drop("acks", n)
        self._bytes = sum(self.files.sizes("segments").values())

    def delivered(self, segments: list[str]) -> None:
        """All records of these segments are delivered: they go."""
        with self._lock:
            for n in segments:
                self.files.drop("segments", n)
            self._bytes = sum(self.files.sizes("segments").values())

    def truncate(self) -> bool:
        """Empty the journal if nothing is pending; else compact it. Whether it is empty."""
        if self.pending().limit(1).count():
            self.compact()
            return False
        for n in self.segments():
            self.files.drop("segments", n)
        for n in self.files.names("acks"):
            self.files.drop("acks", n)
        self._bytes = 0
        return True


class DeadLettersFull(RuntimeError):
    pass


class DeadLetters:
    """Batches of logs that could not be delivered, and their states: pending, processing, dead, or deleted. Both are only added to. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, entries: int = 10_000, batch: int = 100, changes: int = 256):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.entries, self.batch, self.changes = entries, batch, changes
        self._lock = threading.RLock()

    def transitions(self) -> DataFrame:
        schema = "id string, n long, state string, attempts int"
        return self.spark.read.schema(schema).json(f"{self.path}/states") if self.files.names("states") else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All batches as DLQ rows."""
        if not [n for n in self.files.names("batches") if n.endswith(".parquet")]:
            return self.spark.createDataFrame([], DLQ)
        own = self.spark.read.schema(DLQ).parquet(f"{self.path}/batches").drop("state", "attempts").dropDuplicates(["id"])
        return own.join(delivery.latest(self.transitions()), "id").select("id", "state", "tenant_id", "attempts", "logs", "created_ms")

    def set(self, changes: list[tuple[str, str, int]]) -> None:
        """(batch, state, attempts) of batches, in one step."""
        if changes:
            n = time.time_ns()
            self.files.write(f"states/{n:020d}-{uuid.uuid4().hex}.json", "".join(json.dumps({"id": i, "n": n, "state": s, "attempts": a}) + "\n" for i, s, a in changes))
            if len(self.files.names("states")) >= self.changes:
                self.compact()

    def add(self, logs: DataFrame) -> int:
        """Logs as pending batches of one tenant each; their number. DeadLettersFull if there would be too many batches that are not dead."""
        with self._lock:
            return self._add(logs)

    def _add(self, logs: DataFrame) -> int:
        stamp, ms = uuid.uuid4().hex, int(time.time() * 1000)
        name = F.concat(F.lit(f"{ms:013d}-{stamp}-"), F.lpad(F.col("batch_no").cast("string"), 9, "0"), F.lit("-"), F.substring(F.sha2(F.col("queue"), 256), 1, 16))
        made = delivery.chunks(logs, "id", self.batch).groupBy(delivery.queue_key().alias("queue"), "batch_no").agg(F.sort_array(F.collect_list(F.struct(*COLUMNS))).alias("logs"), F.first("tenant_id").alias("tenant_id"))
        made = made.select(name.alias("id"), F.lit("pending").alias("state"), "tenant_id", F.lit(0).alias("attempts"), "logs", F.lit(ms).cast("long").alias("created_ms")).persist()
        try:
            ids = [r.id for r in made.select("id").collect()]
            if len(ids) + self.live() > self.entries:
                raise DeadLettersFull(f"the dead letters take {self.entries} batches")
            made.write.mode("append").parquet(f"{self.path}/batches")
            # batches without a state are not there yet
            self.set([(i, "pending", 0) for i in ids])
        finally:
            made.unpersist()
        return len(ids)

    def live(self) -> int:
        return delivery.latest(self.transitions()).where("state <> 'dead'").count()

    def get(self, batch: str) -> dict | None:
        """One batch by id, as it is; nothing is claimed."""
        found = self.read().where(F.col("id") == batch).first()
        return found and found.asDict(recursive=True)

    def collisions(self) -> DataFrame:
        """Batches whose last change is ambiguous: two states at one time."""
        return delivery.state_collisions(self.transitions())

    def compact(self) -> None:
        """One file of states, and batches without the deleted ones."""
        live = self.read().cache()
        try:
            states = [(r.id, r.state, r.attempts) for r in live.select("id", "state", "attempts").collect()]
            old_states, old = self.files.names("states"), self.files.names("batches")
            n = time.time_ns()
            if states:
                live.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
                self.files.write(f"states/{n:020d}-{uuid.uuid4().hex}.json", "".join(json.dumps({"id": i, "n": n, "state": s, "attempts": a}) + "\n" for i, s, a in states))
        finally:
            live.unpersist()
        for x in old:
            self.files.drop("batches", x)
        for x in old_states:
            self.files.drop("states", x)
