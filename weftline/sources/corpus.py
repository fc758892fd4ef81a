"""Corpus folders: shards that a finished download lists, checked and read, on any file system that Spark reads."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import storage

#: Columns of a shard, by name and order.
SHARD = StructType([StructField("text", StringType()), StructField("language", StringType())])


def read_metadata(spark: SparkSession, folder: str) -> dict[str, Any]:
    found = json.loads(storage.read_bytes(spark, f"{folder}/metadata.json"))
    if not isinstance(found, dict):
        raise ValueError(f"{folder}: the metadata isn't an object")
    return found


def shard_paths(spark: SparkSession, folder: str) -> list[str]:
    """The shards in saved order; an error unless the download is complete and each is there."""
    about = read_metadata(spark, folder)
    parts = [str(p) for p in about.get("parts") or []]
    if about.get("status") != "completed" or not parts:
        raise ValueError(f"{folder}: not a completed download")
    if gone := sorted(set(parts) - set(storage.names(spark, str(folder)))):
        raise FileNotFoundError(f"shards are missing: {gone}")
    return [f"{folder}/{p}" for p in parts]


def metadata_signature(spark: SparkSession, folder: str) -> str:
    return hashlib.sha256(storage.read_bytes(spark, f"{folder}/metadata.json")).hexdigest()


def validate_shards(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows, parts, stored and text bytes of a language; an error for an empty shard, another schema, or other totals than noted.

    Spark's tasks read the footers: their merged schema shows what any shard
    has besides, and a shard without texts shows one that lacks the column.
    """
    about, paths = read_metadata(spark, folder), shard_paths(spark, folder)
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    if rows.columns != SHARD.names:
        raise ValueError(f"{folder}: columns {rows.columns}")
    each = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("text").isNotNull(), F.col("language").isNotNull())).alias("whole"))
    found = each.agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum((~(F.col("whole.col1") & F.col("whole.col2"))).cast("int")), F.lit(0)).alias("lacking")).first()
    if found["lacking"] or found["parts"] != len(paths) or found["rows"] != int(about["rows"]):
        raise ValueError(f"{folder}: {found['rows']} rows in {found['parts']} shards that have any, {found['lacking']} without a column or with nulls; {about['rows']} in {len(paths)} are noted")
    return {"rows": int(about["rows"]), "parts": len(paths), "disk_bytes": sum(storage.size(spark, p) for p in paths), "text_bytes": int(about["actual_text_bytes"])}


def validate_sources(spark: SparkSession, root: str, languages: tuple[str, ...], tolerance: int) -> dict[str, dict[str, int]]:
    """What `validate_shards` says of each language; an error if their bytes are further apart than the tolerance."""
    found = {k: validate_shards(spark, f"{root}/{k}") for k in languages}
    sizes = [x["text_bytes"] for x in found.values()]
    if max(sizes) - min(sizes) > tolerance:
        raise ValueError(f"languages have {sizes} bytes: they are {max(sizes) - min(sizes)} apart")
    return found


def read_language(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """(text, language, source_order) of one language; a record of another is an error.

    The order is that of shards as saved and of rows in a shard, from the file's
    own row numbers, so that it holds whatever tasks read what.
    """
    paths = shard_paths(spark, folder)
    rows = spark.read.schema(SHARD).parquet(*paths).select("text", "language", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    place = F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (p.rsplit("/", 1)[-1], i)])
    fits = F.when(F.col("language").eqNullSafe(language), True).otherwise(F.raise_error(F.concat(F.lit("another language: "), F.coalesce("language", F.lit("null")))).cast("boolean"))
    return rows.where(fits).select("text", "language", (F.shiftleft(place[F.col("_file")].cast("long"), 40) + F.col("_row")).alias("source_order"))


def read_corpus(spark: SparkSession, root: str, languages: tuple[str, ...]) -> DataFrame:
    """All languages of a corpus folder, one folder for each."""
    out: DataFrame | None = None
    for language in languages:
        part = read_language(spark, f"{root}/{language}", language)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no languages")
    return out


def after(rows: DataFrame, consumed: int, order: str = "source_order", language: str = "language") -> DataFrame:
    """`rows` but for the first `consumed` of each language: where a capped source goes on."""
    from ..operators.order import ranked

    if not consumed:
        return rows
    left = ranked(rows.select(order, language), language, order).where(F.col("nth") > consumed).select(order, language)
    return rows.join(left, [order, language], "left_semi")


def write_language(rows: DataFrame, folder: str, rows_per_shard: int = 10_000, order: str = "source_order") -> dict[str, Any]:
    """Write one language's records as numbered shards with metadata; refuses a folder that has something.

    Ids alone are ranked; each shard is one task's, and the folder takes its
    name only once the metadata is in it.
    """
    from ..operators.order import ranked, shards

    spark, target = rows.sparkSession, str(folder)
    if storage.names(spark, target):
        raise FileExistsError(target)
    staged = f"{target}.incomplete"
    storage.remove(spark, staged)
    numbered = shards(ranked(rows.select(order, "language"), "language", order), rows_per_shard).select(order, "shard")
    whole = rows.select(order, "language", "text").join(numbered, order)
    whole.repartition("shard").sortWithinPartitions("shard", order).select("text", "language", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(f"{staged}/parts")
    parts = []
    for k in sorted(int(n.split("=")[1]) for n in storage.names(spark, f"{staged}/parts") if n.startswith("shard=")):
        files = [n for n in storage.names(spark, f"{staged}/parts/shard={k}") if n.endswith(".parquet")]
        if len(files) != 1:
            raise RuntimeError(f"shard {k} is in {len(files)} files")
        storage.rename(spark, f"{staged}/parts/shard={k}/{files[0]}", f"{staged}/part-{k:06d}.parquet")
        parts.append(f"part-{k:06d}.parquet")
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    about = {"status": "completed", "parts": parts, "rows": totals["rows"], "actual_text_bytes": int(totals["bytes"]), "records_emitted": totals["rows"]}
    storage.remove(spark, f"{staged}/parts")
    storage.write_bytes(spark, f"{staged}/metadata.json", json.dumps(about, indent=2).encode())
    storage.remove(spark, target)
    storage.rename(spark, staged, target)
    return about
