"""The journal as a stream: a backlog of any size goes to the table in bounded waves, without a record on the driver.

Segments are files that are only ever added, so the file source is the stream: it bounds a wave by files and bytes, and its checkpoint
knows what is done after a restart. (A data source in Python has no say in how much a batch takes.) A segment whose wave is committed is
deleted, which acks its records; a wave that is replayed after a crash changes nothing, as inserts are by id."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from auditmill.operators import delivery
from auditmill.sources import files
from auditmill.sources.journal import Journal
from auditmill.sources.schema import COLUMNS

#: Segments and bytes of one wave.
WAVE_FILES, WAVE_BYTES = 1_000, 64 << 20


def segments(spark: SparkSession, path: str, key: bytes | None = None, wave_files: int = WAVE_FILES, wave_bytes: int = WAVE_BYTES, clean: bool = True, name: str = "*.ndjson") -> DataFrame:
    """A stream of segment and the columns of each readable record of the segments below path, oldest files first."""
    stream = spark.readStream.format("text").option("pathGlobFilter", name).option("maxCachedFiles", 0)
    # the file source takes one of both bounds; bytes are the one that memory needs
    stream = stream.option("maxBytesPerTrigger", wave_bytes) if wave_bytes else stream.option("maxFilesPerTrigger", wave_files)
    if clean:
        stream = stream.option("cleanSource", "delete")
    return files.parsed(stream.load(path), key).select("segment", "log.*")


def work_off(rows: DataFrame, acks: Callable[[], DataFrame], insert: Callable[[DataFrame], None], checkpoint: str, attempts: int = 3, backoff_ms: int = 1000, dead_letter: Callable[[DataFrame, Exception], None] | None = None) -> StreamingQuery:
    """Insert the stream's records that have no ack, wave by wave, until all that is there now is done. acks() is read anew for each wave.

    A wave that insert() refuses `attempts` times goes to dead_letter(); without that the query fails, and the wave is the next one's first."""

    def wave(batch: DataFrame, _: int) -> None:
        # a stream's batch is planned without adaptive execution: a join by shuffle leaves as many parts as there may be, for each of which all later steps would have a task
        own = delivery.pending(batch.select(*COLUMNS), acks()).coalesce(max(1, batch.rdd.getNumPartitions())).persist()
        try:
            for attempt in range(attempts):
                try:
                    insert(own)
                    return
                except Exception as e:  # noqa: BLE001 - any failure of the destination is retried, then dead-lettered
                    if attempt + 1 < attempts:
                        time.sleep(backoff_ms * 2**attempt / 1000)
                    elif dead_letter:
                        dead_letter(own, e)
                    else:
                        raise
        finally:
            own.unpersist()

    return rows.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(journal: Journal, insert: Callable[[DataFrame], None], checkpoint: str, **options) -> None:
    """Work off what a journal holds now, and drop its segments once they are."""
    own = journal.segments()
    if own:
        query = work_off(segments(journal.spark, f"{journal.path}/segments", journal.key), journal.acks, insert, checkpoint, **options)
        query.awaitTermination()
        journal.delivered(own)
