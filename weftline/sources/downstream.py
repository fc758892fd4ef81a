"""Task datasets: raw columns to canonical ones, splits, and encoded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import normalize

#: Raw columns of each task and what they become.
COLUMNS = {
    "ner": {"hindi_words": "tokens", "labels": "ner_tags"},
    "pos": {"words": "tokens", "label1": "pos_tags_primary", "label2": "pos_tags_secondary"},
    "sentiment": {"label": "sentiment_label"},
}
LABEL_FIELD = {"ner": "ner_tags", "pos": "pos_tags_secondary", "sentiment": "sentiment_label"}


def task_of(repository: str) -> str:
    upper = repository.upper()
    for task in ("ner", "pos", "sentiment"):
        if f"_{task.upper()}_" in upper:
            return task
    raise ValueError(f"no task in {repository}")


def pair_of(repository: str) -> str:
    return "-".join(repository.split("_")[-2:]).lower()


def canonical(raw: DataFrame, repository: str, keep_original: bool = False) -> DataFrame:
    """Rows with the canonical columns of their task: word tasks get a text of their words, sentiment a normalized one."""
    task = task_of(repository)
    named = COLUMNS[task]
    added = {new: F.col(old) for old, new in named.items()}
    added["text"] = normalize(F.col("text")) if task == "sentiment" else F.array_join(F.col(next(iter(named))), " ")
    added |= {"task": F.lit(task), "language_pair": F.lit(pair_of(repository))}
    others = [c for c in raw.columns if keep_original and c not in added] + [c for c in ("split",) if not keep_original and c in raw.columns]
    return raw.select(*others, *(e.alias(n) for n, e in added.items()))


def folder_name(repository: str) -> str:
    return repository.replace("/", "__").replace(" ", "_")


def split_counts(rows: DataFrame, expected: tuple[str, ...] = ()) -> dict[str, int]:
    """Rows of each split; an error if there are none, or none in a split that is expected."""
    found = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    if empty := sorted(set(expected) - set(found)) or not found:
        raise ValueError(f"no rows in {empty if found else 'any split'}")
    return found


def save(rows: DataFrame, folder: str) -> dict[str, int]:
    """Write a dataset by split beside its place, check it, then give it its name; one that is there and complete is told and left."""
    spark, target = rows.sparkSession, str(folder)
    if "_SUCCESS" in storage.names(spark, target):
        return validate(spark, target)
    if storage.names(spark, target):
        raise FileExistsError(target)
    staged = f"{target}.incomplete"
    rows.write.mode("overwrite").partitionBy("split").parquet(staged)
    counts = split_counts(load(spark, staged))
    storage.remove(spark, target)
    storage.rename(spark, staged, target)
    return counts


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(str(folder))


def validate(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows of each split of a saved dataset, whose folders name the splits; an error if it isn't there or a split has no rows."""
    if not storage.exists(spark, str(folder)):
        raise FileNotFoundError(str(folder))
    names = tuple(n.split("=", 1)[1] for n in storage.names(spark, str(folder)) if n.startswith("split="))
    return split_counts(load(spark, folder), names)


def limited(rows: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows of each split by `order`; 0 keeps all, less is an error."""
    from ..operators.order import ranked

    if limit < 0:
        raise ValueError("a limit isn't negative")
    if limit == 0:
        return rows
    first = ranked(rows.select("split", order), "split", order).where(F.col("nth") <= limit).select("split", order)
    return rows.join(first, ["split", order], "left_semi")
