"""Capped ingest as a stream: each language's first records up to a number of bytes, written as shards, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.order import ranked
from ..storage import exists, materialize


def take(batch: DataFrame, state: DataFrame, limit: int, order: str, language: str = "language", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(order, language, bytes, running) of the records that still fit into their language's cap, and the state after them.

    state: language, used (bytes so far), consumed (records seen), frozen
    (whether the cap was met): a row for each language. The first record that
    passes the cap ends its language, also for shorter ones that come later.
    Null and empty texts are consumed and left out. Bytes are added up by
    ranges, so that a language isn't one task's.
    """
    narrow = batch.select(order, language, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    told = ranked(narrow, language, order, "bytes").join(F.broadcast(state), language, "left")
    told = told.select(order, language, "bytes", "nth", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("used", "consumed")), F.coalesce("frozen", F.lit(False)).alias("frozen"), "running")
    told = materialize(told.withColumn("running", F.col("running") + F.col("used")).withColumn("fits", ~F.col("frozen") & (F.col("running") <= limit)))
    seen = told.groupBy(language).agg(
        F.max("used").alias("_used"), F.max("consumed").alias("_consumed"), F.max("frozen").alias("_frozen"), F.max("nth").alias("_n"), F.sum(F.when(F.col("fits"), F.col("bytes")).otherwise(0)).alias("_more"), F.min(F.when(~F.col("fits"), F.col("nth"))).alias("_over")
    )
    after = seen.select(
        language,
        (F.col("_used") + F.col("_more")).alias("used"),
        (F.col("_consumed") + F.when(F.col("_frozen"), F.lit(0)).otherwise(F.coalesce("_over", "_n"))).alias("consumed"),
        (F.col("_frozen") | F.col("_over").isNotNull()).alias("frozen"),
    )
    gone = state.join(after.select(language), language, "left_anti").select(language, "used", "consumed", "frozen")
    return told.where(F.col("fits") & (F.col("bytes") > 0)).select(order, language, "bytes", "running"), after.unionByName(gone)


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, limit: int, order: str, language: str = "language", text: str = "text", files_per_batch: int = 1, shard_rows: int = 10_000) -> None:
    """Read a folder of files in order, as far as there is any, and add what fits to `target`/kept: whole records with bytes and running, shards of `shard_rows` at most.

    Run again, it goes on where it stopped. Micro-batches must come in order;
    inside one, records are ordered. A micro-batch writes its records and then
    the state after it, both under its number: one that is run again after a
    failure, from the state before it, replaces what it left.
    """

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        empty = session.createDataFrame([], f"{language} string, used long, consumed long, frozen boolean")
        state = empty
        if number and exists(session, f"{target}/state"):
            found = session.read.parquet(f"{target}/state").where(F.col("batch") < number)
            last = found.agg(F.max("batch").alias("n")).first()["n"]
            state = empty if last is None else found.where(F.col("batch") == last).drop("batch")
        kept, after = take(batch, state, limit, order, language, text)
        whole = batch.join(kept, [order, language])
        whole.write.mode("overwrite").option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(f"{target}/kept/batch={number}")
        after.coalesce(1).write.mode("overwrite").parquet(f"{target}/state/batch={number}")  # a row for each language

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(spark: SparkSession, target: str, language: str = "language") -> DataFrame:
    """(language, used, consumed, frozen) as of the last micro-batch."""
    found = spark.read.parquet(f"{target}/state")
    last = found.agg(F.max("batch").alias("n")).first()["n"]
    return found.where(F.col("batch") == last).select(language, "used", "consumed", "frozen")
