"""Hash chains: each record holds the hash of the one before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.functions.scalars import GENESIS, content_hash, integrity_payload


def seal(logs: DataFrame, chain: str = "tenant_id", tips: dict[str | None, str] | None = None) -> DataFrame:
    """logs with prev_hash and content_hash, chained by id in each chain, from its tip or the genesis.

    A chain is sealed in one task, as each hash needs the one before; rows stream through it, so a long chain takes no memory."""
    tips = tips or {}
    columns = [c for c in logs.columns if c not in ("prev_hash", "content_hash")]
    held = logs.select(*columns, integrity_payload().alias("_payload"))
    schema = held.drop("_payload").schema.add("prev_hash", "string").add("content_hash", "string")
    at = columns.index(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tip, begun = None, GENESIS, False
        for batch in batches:
            prev, own = [], []
            for k, payload in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if not begun or k != key:
                    key, tip, begun = k, tips.get(k, GENESIS), True
                prev.append(tip)
                tip = hashlib.sha256(f"{tip}\n{payload}".encode()).hexdigest()
                own.append(tip)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*columns, "prev_hash", "content_hash"])

    sealed = held.repartition(chain).sortWithinPartitions(chain, "id").mapInArrow(run, schema)
    return sealed.select(*(c for c in logs.columns if c in columns or c in ("prev_hash", "content_hash")))


def _judged(rows: DataFrame) -> DataFrame:
    """rows (prev_hash, content_hash, own, expected) with the first error of each, null if it has none."""
    missing = (F.coalesce("prev_hash", F.lit("")) == "") | (F.coalesce("content_hash", F.lit("")) == "")
    return rows.withColumn("error", F.when(missing, "missing integrity fields").when(F.col("prev_hash") != F.col("expected"), "prevHash mismatch").when(F.col("own") != F.col("content_hash"), "contentHash mismatch"))


def failures(logs: DataFrame, chain: str = "tenant_id", genesis: str = GENESIS, slices: int | None = None) -> DataFrame:
    """chain, failed_at (row from 0), error of the first bad record of each chain that has one. Every record is judged on its own and the one before.

    Rows are dealt by ranges of (chain, id), so a chain of any length is judged by many tasks. A range knows the record before all of its own but the
    first. It becomes one row for each chain in it: its first record, its last hash, and what was found on the way; these rows
    are put in order and the first records judged. Null chains are one chain."""
    n = slices or logs.sparkSession.sparkContext.defaultParallelism * 4
    # what is judged is hashed before it moves, so only hashes do
    rows = logs.select(chain, "id", "prev_hash", "content_hash", content_hash(F.col("prev_hash"), integrity_payload()).alias("own"))
    dealt = rows.repartitionByRange(n, chain, "id").sortWithinPartitions(chain, "id").withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy("_range", chain).orderBy("id")
    at = _judged(dealt.withColumns({"_n": (F.row_number().over(own) - 1).cast("long"), "expected": F.coalesce(F.lag("content_hash").over(own), F.lit(genesis))}))
    found = F.min(F.when((F.col("_n") > 0) & F.col("error").isNotNull(), F.struct("_n", "error"))).alias("found")
    parts = at.groupBy("_range", chain).agg(F.count("*").alias("_count"), F.min("id").alias("_start"), F.min_by(F.struct("prev_hash", "content_hash", "own"), "_n").alias("first"), F.max_by(F.struct("content_hash"), "_n").alias("last"), found)
    along = Window.partitionBy(chain).orderBy("_start")
    expected = F.when(F.row_number().over(along) == 1, F.lit(genesis)).otherwise(F.coalesce(F.lag("last").over(along)["content_hash"], F.lit(genesis)))
    firsts = _judged(parts.select(chain, "found", (F.sum("_count").over(along) - F.col("_count")).alias("_before"), "first.*", expected.alias("expected")))
    bad = firsts.select(chain, F.when(F.col("error").isNotNull(), F.struct(F.col("_before").alias("at"), "error")).otherwise(F.struct((F.col("_before") + F.col("found._n")).alias("at"), F.col("found.error").alias("error"))).alias("bad"))
    return bad.where("bad.error is not null").groupBy(chain).agg(F.min("bad").alias("bad")).select(chain, F.col("bad.at").cast("long").alias("failed_at"), F.col("bad.error").alias("error"))


def failures_of_one(logs: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """failures() of logs as one chain by id."""
    return failures(logs.withColumn("_one", F.lit(1)), "_one", genesis)
