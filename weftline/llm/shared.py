"""What the operators share: tables, and results settled in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: Bytes of text that a task has in Python at once; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of one key that a join gives to a single task at most; keys of more are joined by broadcast.
HOT_ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session that names none (tests, one machine) gets a temporary folder
    once for the application; on a cluster that is an error, since each executor
    would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
    return _FALLBACK[app]


def settle(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again.

    This cuts the lineage with files that outlive any executor, keeps columns
    prunable, and fixes values such as partition ids. The files go when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch: pa.RecordBatch, column: int, most_rows: int = 512, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts, bytes or lists of numbers in a column come to `most_bytes` at most, a row at least in each."""
    values = batch.column(column)
    length = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = np.asarray(pc.fill_null(length, 0), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        stop = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], n: str, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """`rows` with what `facts` says of their key; facts: a row for each key, with how many rows (`n`) have it.

    A key of a third of all rows would be one task's. Keys of more than
    `hot_rows` rows are broadcast: of N rows there are N / hot_rows such keys
    at most, each with one narrow fact. All other keys are shuffled.
    """
    most = HOT_ROWS if hot_rows is None else hot_rows
    hot = facts.where(F.col(n) > most).drop(n)
    rest = facts.where(F.col(n) <= most).drop(n)
    told = [c for c in facts.columns if c != n and c not in on]
    mark = "hot" + "_" * max(len(c) for c in (*rows.columns, *facts.columns))
    keyed = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), on, "left")
    columns = [*on, *(c for c in rows.columns if c not in on), *told]
    cold = keyed.where(F.col(mark).isNull()).drop(mark, *told).join(rest, on, how)
    return keyed.where(mark).select(*columns).union(cold.select(*columns))
