"""Results written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets one temporary folder, and on a cluster that is an error: each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weftline-"))


def materialize(df: DataFrame) -> DataFrame:
    """The DataFrame written as Parquet to the shared folder and read again; the files go with the application."""
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(df.sparkSession)}/weftline/{uuid.uuid4().hex}")
    df.write.parquet(place.toString())
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(place.toString())


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    """The Hadoop path and its file system, which may be any that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, in order; nothing if it isn't there."""
    place, fs = _place(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def size(spark: SparkSession, path: str) -> int:
    place, fs = _place(spark, path)
    return fs.getFileStatus(place).getLen()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a file or folder another name; an error if that is taken, or it fails."""
    (a, fs), (b, _) = _place(spark, old), _place(spark, new)
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(str(new))


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes."""
    return bytes(spark.read.format("binaryFile").load(str(path)).select("content").first()["content"])


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, replaced as a whole."""
    place, fs = _place(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(content))
    out.close()
