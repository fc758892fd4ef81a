"""The prepared corpus: scan, normalize, filter, split, interleave, and budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .order import group_sizes, interleave, interleaved_position, keep_prefix, ranked


@dataclass(frozen=True)
class Preparation:
    """How records become the corpus. Languages are in the order in which they take turns."""

    languages: tuple[str, ...] = ("en", "es", "hi")
    unicode_form: bool = True
    collapse: bool = True
    strip: bool = True
    low: int = 1
    high: int = 1_000_000
    seed: int = 42
    validation: float = 0.067
    test: float = 0.033


def prepare(records: DataFrame, how: Preparation, text: str = "text", language: str = "language") -> DataFrame:
    """Records of the plan's languages, normalized and within the length bounds, with their `split`. Null and empty texts go.

    A text is normalized once: the filter on its length isn't pushed below (`functions.text.nfkc`).
    """
    chosen = records.where(F.col(language).isin(*how.languages) & F.col(text).isNotNull() & (F.col(text) != ""))
    plain = chosen.withColumn(text, T.normalize(F.col(text), how.unicode_form, how.collapse, how.strip)).where(T.length_between(F.col(text), how.low, how.high))
    return plain.withColumn("split", T.stable_split(F.col(text), F.col(language), how.seed, how.validation, how.test))


def assert_language(records: DataFrame, wanted: str, language: str = "language") -> DataFrame:
    """`records`; reading one of another language is an error."""
    return records.where(F.when(F.col(language).eqNullSafe(wanted), True).otherwise(F.raise_error(F.concat(F.lit("another language: "), F.coalesce(language, F.lit("null")))).cast("boolean")))


def language_totals(records: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Rows, characters and bytes of each language."""
    return records.groupBy(language).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(text)).cast("long").alias("characters"), F.sum(F.octet_length(text)).cast("long").alias("text_bytes"))


def byte_balance(records: DataFrame, tolerance: int, text: str = "text", language: str = "language") -> DataFrame:
    """Fewest and most bytes of a language, and whether they are within the tolerance."""
    totals = language_totals(records, text, language)
    out = totals.agg(F.min("text_bytes").alias("least_bytes"), F.max("text_bytes").alias("most_bytes"), F.sum("text_bytes").cast("long").alias("all_bytes"))
    return out.withColumn("spread", F.col("most_bytes") - F.col("least_bytes")).withColumn("balanced", F.col("spread") <= tolerance)


def byte_cap(records: DataFrame, limit: int, order: str, text: str = "text", language: str = "language") -> DataFrame:
    """Each language's first records up to the bytes: the first that passes them ends it. (order, language, running)."""
    narrow = records.where(F.col(text).isNotNull() & (F.col(text) != "")).select(order, language, F.octet_length(text).cast("long").alias("bytes"))
    return keep_prefix(ranked(narrow, language, order, "bytes"), limit).select(order, language, "nth", "running")


def training_budget(prepared: DataFrame, how: Preparation, limit: int, order: str, text: str = "text", language: str = "language") -> DataFrame:
    """The training records that a tokenizer is fitted on, in the order in which languages take turns, each up to the bytes."""
    narrow = prepared.where(F.col("split") == "train").select(order, language, F.octet_length(text).cast("long").alias("bytes"))
    kept = keep_prefix(ranked(narrow, language, order, "bytes"), limit)
    # kept rows are counted on the ranges that are written
    keys = list(how.languages)
    return kept.withColumn("position", interleaved_position(F.col("nth"), F.col(language), keys, group_sizes(kept, language, keys)))


def first_per_language(prepared: DataFrame, n: int, order: str, language: str = "language", strict: bool = False) -> DataFrame:
    """Each language's first n records, with their rank; if strict, an error where one has fewer."""
    out = ranked(prepared.select(order, language), language, order).where(F.col("nth") <= n)
    if strict and (short := [r[language] for r in out.groupBy(language).count().where(F.col("count") < n).collect()]):
        raise ValueError(f"too few records in {sorted(short)}")
    return out


def prepared_stream(prepared: DataFrame, how: Preparation, order: str, split: str | None = None, balanced: bool = True, language: str = "language") -> DataFrame:
    """Keys, languages and positions of the corpus, languages taking turns, or one after another if not balanced."""
    rows = prepared if split is None else prepared.where(F.col("split") == split)
    keys = list(how.languages)
    rows = rows.select(order, language)
    if balanced:
        return interleave(rows, language, order, keys)
    nth = ranked(rows, language, order)
    sizes = group_sizes(nth, language, keys)
    start = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, sum(sizes[:i]))])
    return nth.withColumn("position", (start[F.col(language)] + F.col("nth") - 1).cast("long"))
