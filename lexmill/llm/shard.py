"""Contiguous balanced shards from a global prefix sum of byte sizes.

Rows are range-partitioned by id; each partition's total is summed, the totals are summed up
over the partitions (one row each), and every row gets its place in the whole order. The line
of all bytes is cut at equal targets; a row goes to the shard that holds its middle byte, so
shards are contiguous in the order of ids and each size is within one row of the target.

Defined results: null text has no bytes and still its fixed 8; null ids come first; repeated
rows lie next to each other and each has a place; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.storage import stage


def placed(sized: DataFrame, order: list[str], size_col: str, label: str = "placed") -> DataFrame:
    """``sized`` with ``before`` (sizes of all earlier rows), ``place`` (their count) and ``total``.

    The ranged rows are written once, so both uses see the same partition borders.
    """
    ranged = stage(sized.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    within = Window.partitionBy("_part").orderBy(*order)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum(size_col).alias("_s"), F.count("*").alias("_n"))
    starts = totals.select(  # one row for each partition
        "_part",
        F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
        F.sum("_s").over(Window.partitionBy()).alias("total"),
    )
    return (
        ranged.withColumn("_k", F.row_number().over(within))
        .withColumn("_b", F.sum(size_col).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size_col))
        .join(F.broadcast(starts), "_part")
        .select(*sized.columns, (F.col("_s0") + F.col("_b")).alias("before"), (F.col("_n0") + F.col("_k") - 1).alias("place"), "total")
    )


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``: slots count from 0 in each shard, in the order of ids."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    sized = docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    line = placed(sized, [id_col, "text_crc32", "size"], "size", "shard")
    cut = line.withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * before + size) * {shards}) div (2 * total)) as int)"))
    cut = stage(cut, "cut")
    first = F.broadcast(cut.groupBy("shard").agg(F.min("place").alias("_first")))  # one row for each shard
    return cut.join(first, "shard").select(id_col, "size", "text_crc32", "shard", (F.col("place") - F.col("_first")).alias("slot"))
