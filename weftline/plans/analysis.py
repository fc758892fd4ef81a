"""Analysis of paired experiments: result trees, scores by seed, paired tests, bootstrap of the first seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, stats

#: One arm's result, in a tree by repository, `seeds`, seed and arm.
RESULT = "struct<metrics:map<string,double>,predictions:array<bigint>,labels:array<bigint>>"


def results(spark: SparkSession, path: str) -> DataFrame:
    """(repository, task, seed, arm, metrics, predictions, labels) of a file of results, or of a folder of such."""
    tree = f"map<string,struct<task:string,seeds:map<string,map<string,{RESULT}>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", tree)).alias("repository", "r"))
    seeds = whole.select("repository", F.col("r.task").alias("task"), F.explode("r.seeds").alias("seed", "arms"))
    return seeds.select("repository", "task", F.col("seed").cast("int").alias("seed"), F.explode("arms").alias("arm", "x")).select("repository", "task", "seed", "arm", "x.*")


def complete(found: DataFrame, seeds: list[int], arms: list[str]) -> DataFrame:
    """`found`, if each repository has each seed and arm and no other seed; an error that names what differs."""
    wanted = found.select("repository").distinct().select("repository", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).select("*", F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    here = found.where(F.col("arm").isin(arms)).select("repository", "seed", "arm")
    wrong = wanted.join(here, ["repository", "seed", "arm"], "left_anti").union(here.join(wanted, ["repository", "seed", "arm"], "left_anti")).limit(5).collect()
    if wrong:
        raise ValueError(f"results differ from what is configured: {[tuple(r) for r in wrong]}")
    return found


def scores(found: DataFrame, baseline: str, proposed: str) -> DataFrame:
    """(repository, metric, seed, arm, score) of the metrics that both arms have in the first seed, without counts."""
    first = found.groupBy("repository").agg(F.min("seed").alias("seed"))
    named = lambda arm: found.where(F.col("arm") == arm).join(first, ["repository", "seed"]).select(F.explode(F.map_keys("metrics")).alias("name"), "repository").select(F.struct("repository", "name").alias("metric"), "name")
    both = metrics.shared_metrics(named(baseline).where(F.col("name") != "labeled_tokens"), named(proposed), left_out=()).select("metric.repository", F.col("metric.name").alias("metric"))
    told = found.where(F.col("arm").isin(baseline, proposed)).select("repository", "seed", "arm", F.explode("metrics").alias("metric", "score"))
    return told.join(both, ["repository", "metric"], "left_semi")


def paired_predictions(found: DataFrame, seed: int, baseline: str, proposed: str) -> DataFrame:
    """(repository, place, label, baseline, proposed) of one seed; an error where the arms' labels, or how many there are, differ."""
    arm = lambda name, out: found.where((F.col("seed") == seed) & (F.col("arm") == name)).select("repository", F.col("labels").alias(f"_{out}"), F.col("predictions").alias(out))
    both = arm(baseline, "baseline").join(arm(proposed, "proposed"), "repository")
    alike = (F.col("_baseline") == F.col("_proposed")) & (F.size("baseline") == F.size("_baseline")) & (F.size("proposed") == F.size("_baseline"))
    sure = both.where(F.when(alike, True).otherwise(F.raise_error(F.concat(F.lit("labels differ between the arms of "), "repository")).cast("boolean")))
    return sure.select("repository", F.posexplode(F.arrays_zip(F.col("_baseline").alias("label"), "baseline", "proposed")).alias("place", "x")).select("repository", "place", "x.*")


def analyze(found: DataFrame, seeds: list[int], baseline: str, proposed: str, samples: int = 10_000, confidence: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The report of all metrics over all seeds, by repository and metric; and the bootstrap of accuracy on the first configured seed, by repository."""
    whole = complete(found, seeds, [baseline, proposed])
    report = stats.statistics_report(scores(whole, baseline, proposed), ["repository", "metric"], "seed", "arm", "score", baseline, proposed, confidence)
    pairs = paired_predictions(whole, seeds[0], baseline, proposed)
    return report, stats.paired_bootstrap(pairs, ["repository"], "place", samples, seeds[0], confidence)
