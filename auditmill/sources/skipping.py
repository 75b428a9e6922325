"""Skip data: which files can hold a value, by ranges and Bloom filters of each file's columns.

An index has a row for each file, column and block: a block has the column's values of one hash class, a filter of 32,768 bits for about 4,096 of them, and their
least and largest. So a filter's rate of false hits is the same in files of any size, and looking a value up touches one row a file. An indexed file without
a row where a value belongs does not hold it. Both ways are built-in functions over Parquet; the driver gets the names of the files that are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that filters of a query name.
COLUMNS = ("tenant_id", "actor_id", "action", "entity_id")
#: Bits of a block's filter (a bitmap's size in Spark), values that share it, and bits of a value.
BITS, VALUES, HASHES = 32_768, 4_096, 4
#: Parts of a data file's name below its table: month, folder, file.
PARTS = 3


def file_of(path: str = "_metadata.file_path") -> Column:
    """A data file's name below its table. It is cut from the end, as this is done for each row: a search from the start costs more than the rest of a scan."""
    return F.substring_index(path, "/", -PARTS)


def folder_of(file: str = "_file") -> Column:
    return F.substring_index(file, "/", PARTS - 1)


def _bit(value: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), value), F.lit(BITS)).cast("long")


def build(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """file, column, block, blocks, low, high, bits of rows, which have their file's name (_file)."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns)))
    values = rows.select(F.col("_file").alias("file"), each.alias("x")).select("file", "x.*").where("value is not null").distinct()
    blocks = F.ceil(F.count("*").over(Window.partitionBy("file", "column")) / VALUES).cast("int")
    placed = values.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int"))
    bits = placed.select("*", F.explode(F.array(*(_bit(F.col("value"), k) for k in range(HASHES)))).alias("bit"))
    made = bits.groupBy("file", "column", "block", "blocks").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.bitmap_construct_agg("bit").alias("bits"))
    return made.sortWithinPartitions("column", "file")


def is_set(bits: Column, at: Column) -> Column:
    """Whether a bitmap has this bit."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def candidates(index: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """file: those of the index that can hold all of these values at once."""

    def may(column: str, value: str) -> Column:
        v = F.lit(value)
        own = (F.col("column") == column) & (F.col("block") == F.pmod(F.xxhash64(v), F.col("blocks"))) & (F.col("low") <= v) & (F.col("high") >= v)
        return reduce(lambda a, b: a & b, (is_set(F.col("bits"), _bit(v, k)) for k in range(HASHES)), own)

    hit = index.where(reduce(lambda a, b: a | b, (may(c, v) for c, v in wanted.items())))
    return hit.groupBy("file").agg(F.count_distinct("column").alias("n")).where(F.col("n") == len(wanted)).select("file")
