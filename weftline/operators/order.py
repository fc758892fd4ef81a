"""Ranks and running sums over large groups, and streams interleaved in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize


def ranked(rows: DataFrame, key: str, order: str, value: str | None = None) -> DataFrame:
    """`rows` with `nth` (from 1) inside its key by `order`, and `running`, the sum of `value` up to the row.

    A window over the key alone would take a language's whole corpus through
    one task. Rows are ranged by key and order instead; each range ranks its
    own, and takes over what earlier ranges add up to, a row for each range and
    key. Keep `rows` narrow: they are written before they are ranged, so that
    nothing is worked out twice, and after, so that ranges stay the same.
    """
    weight = F.col(value) if value else F.lit(0).cast("long")
    ranged = materialize(materialize(rows.withColumn("_weight", weight)).repartitionByRange(F.col(key), F.col(order)).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(key, "_range")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_weight").alias("_w"))
        .select(key, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_sum"))
    )
    inside = Window.partitionBy(key, "_range").orderBy(order)
    out = ranged.join(starts, [key, "_range"]).withColumn("nth", (F.row_number().over(inside) + F.col("_rows")).cast("long"))
    if value:
        out = out.withColumn("running", (F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_sum")).cast("long"))
    return out.select(*rows.columns, "nth", *(["running"] if value else []))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over as many tasks as there are cores, where their files give fewer; otherwise as they are.

    A Parquet file of one row group is one task's, however its bytes are split.
    Rows are dealt by all they have, so that no id, null or repeated, is a
    task's alone. On a corpus of many row groups nothing is moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, F.xxhash64(*rows.columns))


#: Rows of texts that Spark hands to a Python function at once; its own 10,000, with lists of their words, are hundreds of MB on both sides of each task.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """From now on the session hands over `BATCH_ROWS` rows at once, if it handed over more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def for_python(rows: DataFrame, key: str) -> DataFrame:
    """`rows` dealt by key over all cores: small rows that cost much work each, which Spark would put into few tasks by their bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def keep_prefix(rows: DataFrame, limit: int, running: str = "running") -> DataFrame:
    """Rows up to the first whose running sum passes the limit; a limit of 0 keeps all. Sums of sizes never fall, so nothing after comes back."""
    return rows if limit == 0 else rows.where(F.col(running) <= limit)


def group_sizes(rows: DataFrame, key: str, keys: list[str]) -> list[int]:
    """How many rows each of `keys` has: as many numbers as there are keys."""
    found = {r[key]: r["n"] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isin(keys)).collect()}
    return [found.get(k, 0) for k in keys]


def interleaved_position(nth: Column, key: Column, keys: list[str], sizes: list[int]) -> Column:
    """Place (from 0) of a key's nth row when keys take turns in order and those that run out are passed over.

    All rows of earlier turns go before, and those of this turn whose keys come
    first and have so many rows: sums over the keys, no sort of the rows.
    """
    at = nth.cast("long")
    before = sum((F.least(F.lit(n).cast("long"), at - 1) for n in sizes), F.lit(0).cast("long"))
    place = F.lit(None).cast("long")
    for i, k in enumerate(keys):
        ahead = sum(((F.lit(n) >= at).cast("long") for n in sizes[:i]), F.lit(0).cast("long"))
        place = F.when(key == k, before + ahead).otherwise(place)
    return place


def interleave(rows: DataFrame, key: str, order: str, keys: list[str]) -> DataFrame:
    """`rows` of the given keys with `nth` and their `position` in the interleaved stream."""
    chosen = ranked(rows.where(F.col(key).isin(keys)), key, order)
    return chosen.withColumn("position", interleaved_position(F.col("nth"), F.col(key), keys, group_sizes(chosen, key, keys)))


def batches(rows: DataFrame, size: int, position: str = "position") -> DataFrame:
    """`rows` with `batch`: runs of `size` positions, the last one shorter."""
    return rows.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """`rows` once for each epoch from 0."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def resume(rows: DataFrame, consumed: int, batch: str = "batch") -> DataFrame:
    """What comes after so many batches; an error where there are fewer."""
    there = rows.agg((F.coalesce(F.max(batch), F.lit(-1)) + 1).alias("n")).first()["n"]
    if consumed > there:
        raise ValueError(f"{consumed} batches are said to be consumed, and there are {there}")
    return rows.where(F.col(batch) >= consumed)


def shards(rows: DataFrame, size: int, nth: str = "nth") -> DataFrame:
    """`rows` with `shard` and `row_in_shard` by their rank."""
    return rows.withColumn("shard", F.floor((F.col(nth) - 1) / size).cast("long")).withColumn("row_in_shard", ((F.col(nth) - 1) % size).cast("long"))


def shuffled(rows: DataFrame, seed: int, epoch: int, order: str) -> DataFrame:
    """`rows` with their `position` in a permutation that seed and epoch fix."""
    from ..functions.text import hash_number

    drawn = rows.withColumn("_all", F.lit(0)).withColumn("_draw", F.struct(hash_number(str(seed), str(epoch), F.col(order)), F.col(order)))
    return ranked(drawn, "_all", "_draw").withColumn("position", F.col("nth") - 1).drop("_all", "_draw", "nth")
