"""Contiguous shards of near-equal bytes.

Rows are put in ranges of the id; a global prefix sum of bytes comes from the ranges' totals and a running sum within
each range, and the line of bytes is cut at equal targets. No window runs over more than one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.plans.staging import stage

ROW_BYTES = 16
RANGE_BYTES = 64 << 20


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                keep: list[str] | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """The id, the ``keep`` columns, size (UTF-8 bytes of the text plus ``row_bytes``), text_crc32, shard and slot.

    Shards hold consecutive rows in the order of id, checksum and size (null ids first); a row belongs to the shard in
    which its middle byte falls, so a shard misses its share by less than one row at either end. Slots are places in a
    shard from 0. A null text has no bytes. Rows that agree in id, checksum and size stand next to each other in any
    order. A text of more than a share of all bytes leaves shards without rows. A kept column named like a result is
    refused.
    """
    keep = list(keep or [])
    if {"size", "text_crc32", "shard", "slot", id_col} & set(keep):
        raise ValueError("a kept column has the name of a result")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    order = ["__id", "__crc", "__size"]
    total = rows.agg(F.sum("__size")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    # A salt of the row's place spreads equal rows, which no order tells apart.
    salted = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    parts = stage(salted.repartitionByRange(ranges, *order, "__salt").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sums = parts.groupBy("__part").agg(F.sum("__size").alias("__b"), F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__before"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows"))
    within = Window.partitionBy("__part").orderBy(*order, "__salt").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumns({"__run": F.sum("__size").over(within), "__at": F.row_number().over(within)}).join(
        F.broadcast(sums), "__part").withColumns({
            "__shard": F.expr(f"cast((2 * (__before + __run) - __size) * {shards} div {2 * max(total, 1)} as int)"),
            "__row": F.col("__rows") + F.col("__at") - 1})
    # One row a shard.
    firsts = placed.groupBy("__shard").agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(firsts), "__shard").select(
        F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"),
        (F.col("__row") - F.col("__first")).alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows with all their columns, one folder a shard, sorted by slot."""
    placed = byte_shards(docs, shards, id_col, text_col, keep=[c for c in docs.columns if c != id_col])
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
