"""Mixing sources to target weights by a curriculum whose weights change in time.

Each source has a schedule: phases of training with a weight. Its integral is the source's weight in the whole mix. Sources share the words to
be taken by their weights, up to a number of passes over each; what a source can't give goes to the others. Within a phase a source's words are
demanded evenly, so its cumulative demand is piecewise linear in time and its inverse gives each copy of a document the time at which it is due:
documents of a source follow one another in an order by digest, and the middle of a copy is the demand that it meets. Copies whose middle lies beyond the
source's target are not taken. Documents are range-sorted by their training positions.

Everything is DataFrame expressions. Running sums go in two levels, over buckets of documents and over a source's buckets, so that a source may
hold any share of the rows; a rank of sources goes over ranges of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.shared import written
from auditmill.operators.scans import running

WORD = r"[^\x20\x09-\x0D]+"
#: Rows, about, whose sizes are summed up one after another.
BUCKET_ROWS = 50_000
#: Rows that agree in all but their place are placed in parts of so many.
COPIES = 10_000
#: Passes over a source, at most.
PASSES = 3


class Phase(NamedTuple):
    #: Share of the training time; those of a schedule add up to 1.
    length: float
    weight: float


#: Schedules of the sources, by rank and repeating: early, even and late ones, that weigh 1, 2 and 3.
CYCLE = ((Phase(0.5, 1.5), Phase(0.5, 0.5)), (Phase(1.0, 2.0),), (Phase(0.25, 1.0), Phase(0.5, 3.0), Phase(0.25, 5.0)))
Schedule = tuple[Phase, ...]


def weight(schedule: Schedule) -> float:
    """The integral of a schedule."""
    if not schedule or abs(sum(p.length for p in schedule) - 1) > 1e-9 or any(p.length <= 0 or p.weight < 0 for p in schedule):
        raise ValueError("a schedule's phases have positive lengths that add up to 1, and no negative weights")
    total = sum(p.length * p.weight for p in schedule)
    if total <= 0:
        raise ValueError("a schedule weighs something")
    return total


def pieces(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(demand at the start, demand at the end, time at the start, time per demand) of each phase that demands something; demands are shares of the whole."""
    total, out, demand, time = weight(schedule), [], 0.0, 0.0
    for p in schedule:
        own = p.length * p.weight / total
        if own > 0:
            out.append((demand, demand + own, time, p.length / own))
        demand, time = demand + own, time + p.length
    return out


def due(share: Column, schedule: Column, cycle: tuple[Schedule, ...]) -> Column:
    """The time from 0 to 1 at which a source's demand reaches this share of its whole; schedule is a number in cycle."""
    out = F.lit(None).cast("double")
    for k, one in enumerate(cycle):
        own = pieces(one)
        at = F.lit(own[-1][2]) + (share - F.lit(own[-1][0])) * F.lit(own[-1][3])
        for start, end, time, per in reversed(own[:-1]):
            at = F.when(share < F.lit(end), F.lit(time) + (share - F.lit(start)) * F.lit(per)).otherwise(at)
        out = F.when(schedule == k, at).otherwise(out)
    return out


def _ranged(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows in ranges of this order, each with its number (_part)."""
    return written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def targets(sizes: DataFrame, cycle: tuple[Schedule, ...] = CYCLE, passes: float = PASSES) -> DataFrame:
    """source, source_size, schedule, target of sizes (source, source_size), a row for each source.

    Sources by code point, null last, have the schedules of cycle one after another. They share the sum of all sizes by weight. Above `passes` times its
    size a source gets no more, and the others share the rest in the same way: the common level is the largest that any set of the first sources by
    size per weight, taken as full, asks for."""
    by_name = F.col("source").asc_nulls_last()
    ranked = running(_ranged(sizes, "sources", by_name), "_part", (by_name,), F.lit(1), "rank").drop("_part")
    weights = F.array(*(F.lit(float(weight(s))) for s in cycle))
    own = ranked.withColumn("schedule", ((F.col("rank") - 1) % len(cycle)).cast("int")).drop("rank").withColumn("weight", F.get(weights, F.col("schedule")))
    own = own.withColumn("full", F.col("source_size") * F.lit(float(passes)))
    by_need = (F.col("full") / F.col("weight"), by_name)
    summed = _ranged(own, "targets", *by_need)
    for value, name in (("full", "_fulls"), ("weight", "_weights")):
        summed = running(summed, "_part", by_need, F.col(value), name)
    whole = own.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest = (F.lit(float(whole.size or 0)) - (F.col("_fulls") - F.col("full"))) / (F.lit(whole.weight or 0.0) - (F.col("_weights") - F.col("weight")))
    level = summed.agg(F.max(rest)).first()[0] or 0.0
    return own.select("source", "source_size", "schedule", F.least(F.col("full"), F.lit(level) * F.col("weight")).alias("target"))


def _number(text: Column) -> Column:
    """52 bits of a digest of text."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def order_key() -> Column:
    """A row's place among its source's rows."""
    return _number(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("part").cast("string")))


def plan(docs: DataFrame, cycle: tuple[Schedule, ...] = CYCLE, passes: int = PASSES, bucket_rows: int = BUCKET_ROWS, copies: int = COPIES) -> DataFrame:
    """doc_id, source, size, digest, source_size, target, positions, taken of each row of docs (doc_id, text, source; other columns are not used), range-sorted
    by first position, and those that are not taken last.

    size: words of the text (null: 0). target: words to be taken of the row's source. positions: words of the whole mix before which each copy of the row is
    due, from none to `passes` of them, ascending. taken: words that the mix takes, repeats counted. A source's taken words differ from its target by half
    of one document at most. A null source is one of its own, and so is the empty one. Rows are ordered within their source by a digest of doc_id and
    text, so reruns agree; of rows that agree in doc_id, source and text it is open which is which. A row without words is taken as others are, and gives none;
    a source without words has target 0 and none of its rows is taken. An empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    held = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("digest"))
    n = held.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("all"))
    n = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / copies))).alias("part")).withColumn("n", F.least(F.col("all") - F.col("part") * copies, F.lit(copies)))
    rows = written(n.select("doc_id", "source", "size", "digest", "part", "n", order_key().alias("h")), "sizes")
    buckets = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // bucket_rows))
    # by the leading bits, so that buckets follow each other in the order of h
    bucket = F.shiftright(F.shiftright("h", 22) * buckets, 30)
    rows = rows.withColumn("bucket", bucket)
    sums = written(rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "buckets")
    shares = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, passes)
    total = float(sums.agg(F.sum("words")).first()[0] or 0)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    offsets = sums.select("source", "bucket", before.alias("before"))
    offsets = _by_source(offsets, shares).withColumnRenamed("source", "_source").withColumnRenamed("bucket", "_bucket")
    own = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "digest", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("n")
    placed = rows.withColumn("own", own).join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    placed = placed.withColumn("start", F.col("before") + F.col("own") + F.col("k") * F.col("size"))

    def position(r: Column) -> Column:
        # twice the middle of the copy of pass r, in words of the source's passes
        middle = ((r * F.col("source_size") + F.col("start")) * 2 + F.col("size")).cast("double")
        return F.when(middle < F.col("target") * 2, F.floor(due(middle / (F.col("target") * 2), F.col("schedule"), cycle) * F.lit(total)))

    placed = placed.withColumn("positions", F.array_compact(F.array(*(position(F.lit(r).cast("long")) for r in range(passes)))))
    out = placed.withColumn("taken", F.col("size") * F.size("positions")).withColumn("_first", F.get("positions", F.lit(0)))
    out = out.orderBy(F.col("_first").asc_nulls_last(), "doc_id", "digest", "part", "k")
    return out.select("doc_id", "source", "size", "digest", "source_size", "target", "positions", "taken")


def _by_source(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """rows with the columns of their source's row in shares."""
    named = shares.withColumnRenamed("source", "_name")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")


def curriculum(docs: DataFrame, cycle: tuple[Schedule, ...] = CYCLE, passes: int = PASSES) -> DataFrame:
    """position, doc_id, source, text of each copy that training takes, range-sorted by position: written as files, they are read in this order. A null text comes as an empty one."""
    planned = plan(docs, cycle, passes).where(F.size("positions") > 0).select("doc_id", "source", "digest", F.explode("positions").alias("position"))
    texts = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("digest", F.md5(F.col("text").cast("binary")))
    a, b = planned.alias("a"), texts.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.digest") == F.col("b.digest"))
    return a.join(b, same).select("a.position", "a.doc_id", "a.source", "b.text").orderBy("position", "doc_id", "a.digest")
