"""Contiguous shards of near-equal bytes, by prefix sums over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, text_of

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut documents, in id order, into `shards` contiguous runs of near-equal bytes.

    Returns (doc_id, size, text_crc32, shard, slot), where doc_id is `id_col`.
    Only id, size and checksum leave the scan. The narrow rows are ranged by
    id; each range gives one total, the running sum of the totals (one row a
    partition) gives each range its start, and a window inside the range gives
    each row the bytes before it. A row goes to the shard in whose target its
    middle byte lies, so a shard misses its target by one row's size at most.
    slot counts the rows of a shard from 0 without gaps.

    Null text counts no bytes; null ids come first; rows with equal ids are
    ordered by size and checksum, repeated rows each keep a slot of their own;
    an empty table gives no rows; other columns are ignored. Equal texts aren't
    kept together: a group of copies may outgrow any shard.
    """
    key = ["doc_id", "size", "text_crc32"]
    narrow = settle(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text_of(text_col)) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text_of(text_col)).alias("text_crc32")))
    ranged = settle(narrow.repartitionByRange(*[F.col(k).asc_nulls_first() for k in key]).withColumn("range_id", F.spark_partition_id()))
    earlier = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("range_id")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "range_id",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        )
    )
    inside = Window.partitionBy("range_id").orderBy(*[F.col(k).asc_nulls_first() for k in key])
    before = F.col("bytes_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = settle(
        ranged.join(F.broadcast(starts), "range_id")  # a row for each partition of the exchange
        .select(*key, "total", before.alias("before"), (F.col("rows_before") + F.row_number().over(inside) - 1).alias("nth"))
        .select(*key, "nth", F.expr(f"cast(least({shards - 1}, (2 * before + size) * {shards} div (2 * total)) as int)").alias("shard"))
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(*key, "shard", (F.col("nth") - F.col("first")).cast("long").alias("slot"))
