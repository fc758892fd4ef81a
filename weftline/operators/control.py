"""Training control: learning rates, early stopping, checkpoints, reuse of stages."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def learning_rates(spark: SparkSession, total: int, warmup: int) -> DataFrame:
    """(step, factor): rising for `warmup` steps, then falling to 0 at `total`."""
    step = F.col("id")
    factor = F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), (F.lit(total) - step) / max(1, total - warmup)))
    return spark.range(total + 1).select(F.col("id").alias("step"), factor.cast("double").alias("factor"))


def pretrain_warmup(total: int, share: float) -> int:
    return int(total * share)


def finetune_warmup(total: int, share: float) -> int:
    """Rounded half to even."""
    return int(round(total * share))


def early_stopping(evaluations: DataFrame, patience: int, by: list[str], step: str = "step", loss: str = "loss") -> DataFrame:
    """Evaluations up to the stop, with improved, the best loss so far, and how many in a row haven't improved."""
    so_far = Window.partitionBy(*by).orderBy(step)
    best = F.min(loss).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    out = evaluations.withColumn("_best", best).withColumn("improved", F.col("_best").isNull() | (F.col(loss) < F.col("_best")))
    out = out.withColumn("_island", F.sum(F.col("improved").cast("int")).over(so_far))
    waited = F.row_number().over(Window.partitionBy(*by, "_island").orderBy(step)) - 1
    out = out.withColumn("waited", waited.cast("long")).withColumn("best_loss", F.least(F.col(loss), F.col("_best")))
    out = out.withColumn("_stops", F.coalesce(F.sum((F.col("waited") >= patience).cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.where("_stops = 0").withColumn("stop", F.col("waited") >= patience).drop("_best", "_island", "_stops")


def best_epoch(epochs: DataFrame, by: list[str], metric: str, epoch: str = "epoch") -> DataFrame:
    """The first epoch of the largest metric."""
    place = Window.partitionBy(*by).orderBy(F.col(metric).desc(), F.col(epoch).asc())
    return epochs.withColumn("_nth", F.row_number().over(place)).where("_nth = 1").drop("_nth")


def retained(checkpoints: DataFrame, most: int, by: list[str], name: str = "name") -> DataFrame:
    """Numbered checkpoints with `kept`: the last `most` by name; none goes if that isn't positive."""
    if most <= 0:
        return checkpoints.withColumn("kept", F.lit(True))
    return checkpoints.withColumn("kept", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(name).desc())) <= most)


def resolve_checkpoint(checkpoints: DataFrame, by: list[str], preference: list[str], name: str = "name", complete: str = "complete") -> DataFrame:
    """Of the complete checkpoints the first of the preferred names there is, else the last by name."""
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col(name))
    place = Window.partitionBy(*by).orderBy(F.when(rank > 0, rank).otherwise(len(preference) + 1), F.col(name).desc())
    return checkpoints.where(F.col(complete)).withColumn("_nth", F.row_number().over(place)).where("_nth = 1").drop("_nth")


def resolve_splits(names: DataFrame, by: list[str], name: str = "name", position: str = "position") -> DataFrame:
    """(…, train, validation, test): the first name that begins so; an error where one is missing."""
    lower = F.lower(F.col(name))
    first = lambda *starts: F.min_by(F.when(_begins(lower, starts), F.col(name)), F.when(_begins(lower, starts), F.col(position)))
    out = names.groupBy(*by).agg(first("train").alias("train"), first("dev", "validation", "valid").alias("validation"), first("test").alias("test"))
    missing = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"no {c} split")).cast("string")).alias(c)
    return out.select(*by, *map(missing, ("train", "validation", "test")))


def _begins(text: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | text.startswith(s)
    return out


def reusable(stages: DataFrame, wanted: DataFrame, key: str = "stage") -> DataFrame:
    """`wanted` (key, signature, valid) with `reuse`: completed before under that signature, and still valid; unknown counts as not."""
    done = stages.select(key, F.col("status").alias("_status"), F.col("signature").alias("_signature"))
    reuse = (F.col("_status") == "completed") & (F.col("_signature") == F.col("signature")) & F.col("valid")
    return wanted.join(done, key, "left").withColumn("reuse", F.coalesce(reuse, F.lit(False))).drop("_status", "_signature")


def missing(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """What is wanted and isn't there."""
    return wanted.join(present, on, "left_anti")


def run_matrix(repositories: DataFrame, seeds: list[int], arms: list[str], done: DataFrame, evaluate_only: bool = False) -> DataFrame:
    """(repository, seed, arm) of the runs that are still to do: lists of settings are multiplied out, finished runs left out.

    Where runs are only evaluated, one that isn't finished is an error.
    """
    wanted = repositories.select("repository", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).select("*", F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    left = missing(wanted, done, ["repository", "seed", "arm"])
    if evaluate_only and (some := left.limit(5).collect()):
        raise ValueError(f"there are no results to evaluate: {[tuple(r) for r in some]}")
    return left


def log_scalars(values: DataFrame, path: str) -> None:
    """Add (run, tag, step, value) to a table of scalars, which is read as any other."""
    values.select("run", "tag", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


def run_in_order(stages: list[tuple[str, Callable[[], object]]], waits: Callable[[], bool] = lambda: False, pause: float = 30.0, note: Callable[[dict], None] = lambda _: None) -> list[str]:
    """Do stages one after another once `waits` says no; the first that fails is noted and ends it. Names of those that are done."""
    while waits():
        note({"status": "waiting"})
        time.sleep(pause)
    done: list[str] = []
    for name, work in stages:
        note({"status": "running", "stage": name, "done": list(done)})
        try:
            work()
        except Exception as error:
            note({"status": "stopped", "stage": name, "done": list(done), "error": f"{type(error).__name__}: {error}"})
            raise
        done.append(name)
    note({"status": "completed", "done": list(done)})
    return done
