"""Statistics of paired experiments: seed summaries, paired tests, bootstraps, reports."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.student import t_quantile, t_two_sided

def seed_summary(scores: DataFrame, by: list[str], score: str = "score", confidence: float = 0.95) -> DataFrame:
    """n, mean, standard deviation and t interval of each group's scores; one score has no spread, and its interval is itself."""
    out = scores.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd"))

    @F.arrow_udf(DoubleType())
    def quantile_of(n: pa.Array) -> pa.Array:
        known = {k: t_quantile((1 + confidence) / 2, k - 1) for k in set(n.to_pylist()) if k > 1}
        return pa.array([known.get(k) for k in n.to_pylist()], pa.float64())

    quantile = quantile_of("n")
    half = F.when(F.col("n") > 1, quantile * F.col("sd") / F.sqrt("n")).otherwise(F.lit(0.0))
    return out.withColumn("lower", F.col("mean") - half).withColumn("upper", F.col("mean") + half)


def paired(scores: DataFrame, by: list[str], seed: str, arm: str, score: str, baseline: str, proposed: str) -> DataFrame:
    """(…, seed, baseline, proposed) of scores that both arms have; an error where one of them lacks a seed."""
    both = scores.groupBy(*by, seed).agg(F.max(F.when(F.col(arm) == baseline, F.col(score))).alias("baseline"), F.max(F.when(F.col(arm) == proposed, F.col(score))).alias("proposed"))
    whole = F.col("baseline").isNotNull() & F.col("proposed").isNotNull()
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("an arm lacks a seed")).cast("boolean")))


def paired_seed_test(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, mean difference, t and two-sided p of proposed less baseline.

    One pair has no t and p (NaN). Pairs that all differ alike have an infinite
    t and p 0, or NaN if they don't differ.
    """
    d = F.col("proposed") - F.col("baseline")
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd"))
    nan = F.lit(float("nan"))
    still = F.when(F.col("mean_difference") == 0, nan).otherwise(F.signum("mean_difference") * F.lit(float("inf")))
    out = out.withColumn("t", F.when(F.col("n") < 2, nan).when(F.col("_sd") == 0, still).otherwise(F.col("mean_difference") / (F.col("_sd") / F.sqrt("n"))))

    @F.arrow_udf(DoubleType())
    def p_value(t: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([math.nan if k < 2 else t_two_sided(x, k - 1) for x, k in zip(t.to_pylist(), n.to_pylist(), strict=True)], pa.float64())

    return out.withColumn("p", p_value("t", "n")).drop("_sd")


def bootstrap_accuracy(label: np.ndarray, baseline: np.ndarray, proposed: np.ndarray, samples: int, seed: int, confidence: float) -> dict[str, float]:
    """Resampled differences of accuracy, one stream of random numbers for the group.

    Right answers are counted as whole numbers, and divided once.
    """
    gain = (proposed == label).astype(np.int64) - (baseline == label)
    n, rng = len(gain), np.random.default_rng(seed)
    if not n:
        raise ValueError("nothing to resample")
    sums = np.array([gain[rng.integers(0, n, size=n)].sum() for _ in range(samples)])
    tail = (1 - confidence) / 2
    low, high = np.quantile(sums / n, [tail, 1 - tail])
    return {"observed": gain.sum() / n, "mean": (sums / n).mean(), "lower": low, "upper": high, "p": 2 * min((sums <= 0).mean(), (sums >= 0).mean())}


def bootstrap_metric(label: np.ndarray, baseline: np.ndarray, proposed: np.ndarray, metric: Callable[[np.ndarray, np.ndarray], float], samples: int, seed: int, confidence: float) -> dict[str, float]:
    """As `bootstrap_accuracy`, with the same draws, for any metric of labels and predictions."""
    n, rng = len(label), np.random.default_rng(seed)
    if not n:
        raise ValueError("nothing to resample")
    drawn = (rng.integers(0, n, size=n) for _ in range(samples))
    gains = np.array([metric(label[i], proposed[i]) - metric(label[i], baseline[i]) for i in drawn])
    tail = (1 - confidence) / 2
    low, high = np.quantile(gains, [tail, 1 - tail])
    return {"observed": metric(label, proposed) - metric(label, baseline), "mean": gains.mean(), "lower": low, "upper": high, "p": 2 * min((gains <= 0).mean(), (gains >= 0).mean())}


def paired_bootstrap(predictions: DataFrame, by: list[str], order: str, samples: int = 10_000, seed: int = 1, confidence: float = 0.95, metric: Callable[[np.ndarray, np.ndarray], float] | None = None) -> DataFrame:
    """observed, mean, lower, upper and p of each group's difference in accuracy, or in `metric` of labels and predictions. predictions: …, order, label, baseline, proposed.

    A group is one task's test set, drawn from in order by one stream; groups run beside each other.
    """
    kinds = ", ".join(f"{predictions.schema[c].name} {predictions.schema[c].dataType.simpleString()}" for c in by)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        columns = [group[c].to_numpy() for c in ("label", "baseline", "proposed")]
        found = bootstrap_accuracy(*columns, samples, seed, confidence) if metric is None else bootstrap_metric(*columns, metric, samples, seed, confidence)
        return pd.DataFrame([{**{c: group[c].iloc[0] for c in by}, **found}])

    return predictions.select(*by, order, "label", "baseline", "proposed").groupBy(*by).applyInPandas(one, f"{kinds}, observed double, mean double, lower double, upper double, p double")


def statistics_report(scores: DataFrame, by: list[str], seed: str, arm: str, score: str, baseline: str, proposed: str, confidence: float = 0.95) -> DataFrame:
    """A row for each group: both arms' summaries, and the paired test."""
    pairs = paired(scores, by, seed, arm, score, baseline, proposed)
    side = lambda c: seed_summary(pairs, by, c, confidence).select(*by, *(F.col(x).alias(f"{c}_{x}") for x in ("mean", "lower", "upper")))
    return side("baseline").join(side("proposed"), by).join(paired_seed_test(pairs, by), by)


def report_lines(report: DataFrame, by: list[str]) -> DataFrame:
    """`report` with `line`, a row of a Markdown table; a p that is none reads `not defined`."""
    p = F.when(F.isnan("p"), F.lit("not defined")).otherwise(printed("%.4g", F.col("p")))
    cells = [F.concat_ws(" / ", *by)]
    cells += [F.concat(printed("%.4f", F.col(f"{c}_mean")), F.lit(" ["), printed("%.4f", F.col(f"{c}_lower")), F.lit(", "), printed("%.4f", F.col(f"{c}_upper")), F.lit("]")) for c in ("baseline", "proposed")]
    cells += [printed("%+.4f", F.col("mean_difference")), p]
    return report.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def printed(form: str, number: Column) -> Column:
    """A number as C prints it: rounded by its exact value, and without the zeros at the end that Java's %g leaves (1.230e-09 for 1.23e-09)."""

    @F.arrow_udf(StringType())
    def told(numbers: pa.Array) -> pa.Array:
        return pa.array([None if x is None else form % x for x in numbers.to_pylist()], pa.string())

    return told(number)


def markdown(report: DataFrame, by: list[str], title: str = "Paired comparison") -> str:
    """The report as a Markdown text; it has a row for each task and metric, and is small."""
    rows = report_lines(report, by).orderBy(*by).select("line").collect()
    head = ["| Task | Baseline mean (interval) | Proposed mean (interval) | Mean difference | Paired p |", "|---|---:|---:|---:|---:|"]
    return "\n".join([f"# {title}", "", *head, *(r["line"] for r in rows), ""])
