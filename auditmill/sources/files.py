"""Readers of journal and dead-letter files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions.scalars import decrypt
from auditmill.sources.schema import LOG

_LOGS = f"array<struct<{LOG.replace(' string', ':string').replace(', ', ',')}>>"
_CAMEL = "id string, tenantId string, actorId string, action string, entityId string, oldValues string, newValues string, metadata string, ipAddress string, userAgent string, createdAt string, prevHash string, contentHash string"


def journal(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """segment, log of each readable line of NDJSON segments below path: {"id": ..., "log": {...}} or the log itself.

    CRLF and a missing last newline are fine; lines that aren't JSON, or that the key does not open, are skipped. Nested bags are JSON text."""
    return parsed(spark.read.text(path), key)


def parsed(text: DataFrame, key: bytes | None = None) -> DataFrame:
    """segment, log of each readable line (value), of a table or a stream of text files."""
    lines = text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("segment"), F.rtrim("value").alias("line"))
    if key:
        lines = lines.withColumn("line", decrypt(F.col("line"), F.lit(key)))
    held = F.coalesce(F.get_json_object("line", "$.log"), F.when(F.get_json_object("line", "$.actorId").isNotNull(), F.col("line")))
    # as a generator's row, which is made once: else each column, and the condition, would parse the line anew
    once = lines.select("segment", "line", F.inline(F.array(F.from_json(held, _CAMEL))))
    return once.where("id is not null").select("segment", _renamed(F.col).alias("log"), "line")


def from_camel(x: Column) -> Column:
    """A log with the stored columns' names."""
    return F.when(x.isNotNull(), _renamed(lambda c: x[c]))


def _renamed(of: Callable[[str], Column]) -> Column:
    """The stored columns of what of() has by the names in files."""
    names = zip(_CAMEL.split(", "), LOG.split(", "), strict=True)
    return F.struct(*(of(a.split()[0]).alias(b.split()[0]) for a, b in names))


def acks(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of an ack file, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Dead-letter batches, one JSON document a file: an envelope with logs, or a bare array of logs (attempts 0, the first log's tenant).

    A file that can't be read is a batch of no logs (null). created_ms, by which batches are retried first in first out, is the file's time. The state is the last part of the file's name before .json, pending by default."""
    one = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.trim("value").alias("value"), F.unix_millis("_metadata.file_modification_time").alias("created_ms"))
    bare = F.col("value").startswith("[")
    held = F.from_json(F.when(~bare, F.col("value")), f"id string, tenantId string, attempts int, logs array<struct<{_CAMEL.replace(' string', ':string')}>>")
    listed = F.from_json(F.when(bare, F.col("value")), f"array<struct<{_CAMEL.replace(' string', ':string')}>>")
    name = F.regexp_extract("file", r"^(.*?)(?:\.(pending|processing|dead))?\.json$", 1)
    state = F.regexp_extract("file", r"^(.*?)(?:\.(pending|processing|dead))?\.json$", 2)
    read = one.select("file", "created_ms", name.alias("name"), F.when(state != "", state).otherwise("pending").alias("state"), held.alias("e"), F.coalesce(listed, held["logs"]).alias("logs"))
    return read.select(F.coalesce("e.id", "name").alias("id"), "state", F.coalesce("e.tenantId", F.get("logs", F.lit(0))["tenantId"]).alias("tenant_id"), F.coalesce("e.attempts", F.lit(0)).alias("attempts"),
                       F.transform("logs", from_camel).cast(_LOGS).alias("logs"), "created_ms")
