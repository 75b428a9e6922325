"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

The tree has a fixed form: places in racks in regions, of which shards take some. A row draws paths through it, one after another, each with a time: a region, a rack in
it and a place in that, by hash. It takes the shard of the first path that ends at one; a shard takes a path with the odds of its weight, so shards get rows by
weight. Paths depend on the row alone. So where a weight grows, a shard comes, or a rack or region with it, rows move into that subtree's changed
shards and nowhere else: those that came by its place before they found theirs. Likewise back. One more shard takes rows only into itself, and
topology(n + 1) is topology(n) with one more shard.

That the tree can grow without end, regions 0, 1, 2 to 3, 4 to 7 and so on are groups that draw paths on their own, each at the pace of its places; the group whose shard
comes first in time has the row. Half of the places are taken in all groups but the last, so a row draws a few paths in each: the cost goes with the
logarithm of the regions, not with the shards.

Everything is DataFrame expressions; a path is a short digest.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, about, of one shard that are numbered together.
BUCKET_ROWS = 50_000
#: Rows that agree in all that is returned but their slot are numbered in parts of so many.
COPIES = 10_000


#: Racks of a region, shards of a rack, and paths that a group draws at most.
RACKS, PLACES, DRAWS = 2, 2, 64


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = PLACES, per_region: int = RACKS * PLACES) -> list[Shard]:
    """Shards 0 to shards - 1 of equal weight, in racks and regions of these sizes."""
    return [Shard(f"r{s // per_region}", f"k{s // per_rack}", s) for s in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0, per_rack: int = PLACES, per_region: int = RACKS * PLACES) -> list[Shard]:
    """The tree with one more shard, in the rack and region that topology() has for it."""
    n = max((x.shard for x in tree), default=-1) + 1
    return [*tree, topology(n + 1, per_rack, per_region)[n]._replace(weight=weight)]


def _number(text: Column, start: int = 1) -> Column:
    """52 bits of a hexadecimal digest, from a digit on."""
    return F.conv(F.substring(text, start, 13), 16, 10).cast("long")


class Group(NamedTuple):
    """Regions that draw paths together: their number, and for each place its shard (None: free) and weight."""

    regions: int
    places: list[tuple[int | None, float]]


def groups(tree: list[Shard], racks: int = RACKS, places: int = PLACES) -> list[Group]:
    """The tree's places: regions, racks and shards stand in the order of their first appearance."""
    if not tree or any(not x.weight > 0 or math.isinf(x.weight) for x in tree):
        raise ValueError("a tree needs shards, of positive weights")
    regions: dict[str, dict[str, list[Shard]]] = {}
    for x in tree:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    if any(len(own) > racks or any(len(r) > places for r in own.values()) for own in regions.values()):
        raise ValueError(f"a region has {racks} racks at most, and a rack {places} shards")
    out, first = [], 0
    while first < len(regions):
        n = max(1, first)
        free: list[tuple[int | None, float]] = [(None, 0.0)] * (n * racks * places)
        for i, own in enumerate(list(regions.values())[first : first + n]):
            for j, rack in enumerate(own.values()):
                for k, x in enumerate(rack):
                    free[(i * racks + j) * places + k] = (x.shard, float(x.weight))
        out.append(Group(n, free))
        first += n
    return out


def _listed(values: list) -> Column:
    """An array that is folded to a constant, whatever its length."""
    return F.split(F.lit(",".join("" if v is None else repr(v) for v in values)), ",")


def _found(key: Column, number: int, own: Group, racks: int, places: int, unit: float, draws: int) -> Column:
    """(time, shard) of the first path of a group that ends at a shard; a null shard if none of its paths does."""
    shards, odds = _listed([s for s, _ in own.places]), _listed([w / unit for _, w in own.places])

    def path(at: Column, m: Column) -> Column:
        h = F.md5(F.concat(F.lit(f"{number}:"), m.cast("string"), F.lit(":"), key))

        def step(d: Column) -> Column:
            region, rack, leaf = d["way"] % own.regions, F.floor(d["way"] / own.regions) % racks, F.floor(d["way"] / (own.regions * racks)) % places
            n = ((region * racks + rack) * places + leaf).cast("int")
            taken = (F.get(shards, n) != "") & (F.conv(F.substring(d["h"], 27, 6), 16, 10).cast("long") / F.lit(2.0**24) < F.get(odds, n).cast("double"))
            time = at["time"] - F.log((_number(d["h"]) + 1) / F.lit(2.0**52)) / F.lit(float(len(own.places)))
            return F.struct(time.alias("time"), F.when(taken, F.get(shards, n).try_cast("int")).alias("shard"))

        # a path is drawn once, and only where none before it ended at a shard
        drawn = F.struct(h.alias("h"), _number(h, 14).alias("way"))
        return F.when(at["shard"].isNotNull(), at).otherwise(F.get(F.transform(F.array(drawn), step), F.lit(0)))

    start = F.struct(F.lit(0.0).alias("time"), F.lit(None).cast("int").alias("shard"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), start, path)


def place(key: Column, tree: list[Shard], racks: int = RACKS, places: int = PLACES, unit: float = 1.0, draws: int = DRAWS) -> Column:
    """The shard of a key (a string column). unit: a weight that no shard is above, the same for all trees that are compared.

    A group that has not found a shard in `draws` paths leaves the row to others. If all do, its shard is that of the least of weighted draws of all shards, so that one more takes rows only into itself there too."""
    if any(x.weight > unit for x in tree):
        raise ValueError(f"a weight is above {unit}")
    found = F.array(*(_found(key, g, own, racks, places, unit, draws) for g, own in enumerate(groups(tree, racks, places))))
    first = F.array_min(F.filter(found, lambda x: x["shard"].isNotNull()))
    shards, weights = _listed([x.shard for x in tree]), _listed([float(x.weight) for x in tree])

    def draw(i: Column) -> Column:
        u = (_number(F.md5(F.concat(F.get(shards, i), F.lit(":"), key))) + 1) / F.lit(2.0**52)
        return F.struct((-F.log(u) / F.get(weights, i).cast("double")).alias("draw"), F.get(shards, i).cast("int").alias("shard"))

    least = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(tree) - 1)), draw))
    return F.coalesce(first["shard"], least["shard"])


def buckets(rows: int, shards: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets of each shard that are numbered on their own."""
    return max(1, -(-rows // (bucket_rows * shards)))


def assign(docs: DataFrame, shards: int = 8, bucket_rows: int = BUCKET_ROWS, copies: int = COPIES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text; other columns are not used).

    size is the text's UTF-8 bytes plus 1, text_crc32 that of its bytes; a null text has none. A row's shard follows from its
    doc_id and the number of shards alone (null: as an empty key), and grown_shard is its shard once there is one more. Slots number a
    shard's rows from 0 without gaps, by a digest's bucket, then doc_id, checksum and size. Rows that agree in these are counted first and
    numbered in parts of `copies`, which are dealt over the buckets; each row gets a slot of its own. An empty table gives no rows."""
    tree = topology(shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    n = held.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("all"))
    n = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / copies))).alias("part")).withColumn("n", F.least(F.col("all") - F.col("part") * copies, F.lit(copies)))
    bucket = (_number(F.md5(F.concat(F.lit("bucket:"), key, F.lit(":"), F.concat_ws(":", "text_crc32", "part")))) % buckets(docs.count(), shards, bucket_rows)).cast("long")
    at, grown = place(F.col("key"), tree), place(F.col("key"), grow(tree))
    rows = n.select("*", bucket.alias("bucket"), key.alias("key")).select("*", at.alias("shard"), grown.alias("grown_shard")).drop("key")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).select("shard", "bucket", before.alias("before"))
    own = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    numbered = rows.withColumn("own", own).join(offsets, ["shard", "bucket"])
    first = F.col("before") + F.col("own")
    slots = numbered.select("*", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
