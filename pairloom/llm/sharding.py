"""Contiguous shards of near-equal bytes, from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import cut


def shard_by_bytes(rows: DataFrame, order: list[str], size: str = "size", shards: int = 40) -> DataFrame:
    """rows plus shard (0 .. shards - 1) and slot (gapless from 0 in each shard).

    Rows are put in the order of `order` by range partitions, which split any run of equal
    keys but fully equal rows; the totals of the partitions (one row each) are summed up to
    give each its first byte, and a row goes to the shard that holds its middle byte.  So a
    shard is contiguous and differs from an equal share by less than one row's size.

    Null sizes count as 0 and null keys come first.  Rows that are alike in all of `order`
    keep any order among themselves.  An empty table gives an empty result.  Columns other
    than shard and slot pass through; names that begin with `_pl_` are used inside.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bytes_of = F.coalesce(F.col(size).cast("long"), F.lit(0))
    placed = cut(
        rows.withColumn("_pl_bytes", bytes_of)
        .withColumn("_pl_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *[F.col(c) for c in order], F.col("_pl_tie"))
        .withColumn("_pl_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_pl_part").agg(F.sum("_pl_bytes").alias("_pl_sum"), F.count(F.lit(1)).alias("_pl_n"))
    before = Window.orderBy("_pl_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_pl_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(  # a row for each partition
        "_pl_part",
        F.coalesce(F.sum("_pl_sum").over(before), F.lit(0)).alias("_pl_from"),
        F.coalesce(F.sum("_pl_n").over(before), F.lit(0)).alias("_pl_at"),
        F.sum("_pl_sum").over(whole).alias("_pl_all"),
    )
    run = Window.partitionBy("_pl_part").orderBy(*order, "_pl_tie")
    start = F.col("_pl_from") + F.sum("_pl_bytes").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_pl_bytes")
    middle = (start * 2 + F.col("_pl_bytes")).cast("decimal(38,0)") * shards
    there = (
        placed.join(F.broadcast(bases), "_pl_part")
        .withColumn("_pl_index", F.col("_pl_at") + F.row_number().over(run) - 1)
        .withColumn("shard", F.when(F.col("_pl_all") > 0, F.least(F.lit(shards - 1), F.floor(middle / (F.col("_pl_all") * 2)).cast("int"))).otherwise(F.lit(0)))
    )
    # The first index of a shard: of each partition's first row in it, the least.
    firsts = there.groupBy("shard").agg(F.min("_pl_index").alias("_pl_first"))  # a row for each shard
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    return there.join(F.broadcast(firsts), "shard").select(*keep, F.col("shard").cast("int"), (F.col("_pl_index") - F.col("_pl_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, by `shard_by_bytes` over doc_id.

    A null text has no bytes (size 16, crc32 0); a null doc_id comes first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_by_bytes(rows, ["doc_id", "text_crc32", "size"], "size", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
