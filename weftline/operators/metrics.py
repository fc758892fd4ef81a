"""Classification metrics, token metrics, label vocabularies, and training measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Labels that count for nothing.
IGNORED = -100


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """How often each label meets each prediction."""
    return rows.groupBy(*(by or []), label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """accuracy, macro_f1, micro_f1 and examples; macro over all classes that are a label or a prediction, 0 where F1 has no denominator.

    The rows are counted once into a confusion table; everything else is on
    that table. Nothing comes back for no rows.
    """
    by = by or []
    table = confusion(rows, label, prediction, by)
    sides = table.select(
        *by,
        "n",
        F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("real"), F.lit(0).alias("said")), F.struct(F.col(prediction).alias("class"), F.lit(0).alias("real"), F.lit(1).alias("said")))).alias("side"),
        (F.col(label) == F.col(prediction)).cast("long").alias("hit"),
    )
    classes = sides.groupBy(*by, "side.class").agg(
        F.sum(F.col("n") * F.col("hit") * F.col("side.real")).alias("tp"), F.sum(F.col("n") * F.col("side.real")).alias("real"), F.sum(F.col("n") * F.col("side.said")).alias("said")
    )
    f1 = 2 * F.col("tp") / (F.col("real") + F.col("said"))
    out = classes.groupBy(*by).agg(F.sum("tp").cast("long").alias("right"), F.sum("real").cast("long").alias("examples"), F.avg(f1).alias("macro_f1"))
    out = out.where("examples > 0").withColumn("accuracy", F.col("right") / F.col("examples"))
    return out.select(*by, "accuracy", "macro_f1", F.col("accuracy").alias("micro_f1"), "examples")


def token_pairs(rows: DataFrame, labels: str = "labels", predictions: str = "predictions", keep: list[str] | None = None) -> DataFrame:
    """(…, label, prediction) of each token that has both and isn't ignored; what is longer is cut off."""
    both = F.slice(F.arrays_zip(F.col(labels).alias("label"), F.col(predictions).alias("prediction")), F.lit(1), F.least(F.size(labels), F.size(predictions)))
    pairs = rows.select(*(keep or []), F.explode(both).alias("pair")).select(*(keep or []), F.col("pair.label").alias("label"), F.col("pair.prediction").alias("prediction"))
    return pairs.where(F.col("label") != IGNORED)


def token_metrics(rows: DataFrame, labels: str = "labels", predictions: str = "predictions", by: list[str] | None = None) -> DataFrame:
    """Classification metrics of all tokens that aren't ignored, and how many there are."""
    return classification_metrics(token_pairs(rows, labels, predictions, by), by=by).withColumnRenamed("examples", "labeled_tokens")


def label_vocabulary(labels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels, as text, numbered from 0 in order."""
    distinct = labels.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    return distinct.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("label_id"))


def mean_of_batch_means(rows: DataFrame, loss: str, batch: str, by: list[str], first: int | None = None) -> DataFrame:
    """The mean of each batch's mean loss, over the first batches only if `first` is given; not the mean of all tokens."""
    chosen = rows if first is None else rows.where(F.col(batch) < first)
    return chosen.groupBy(*by, batch).agg(F.avg(loss).alias("_mean")).groupBy(*by).agg(F.avg("_mean").alias("loss"), F.count(F.lit(1)).alias("batches"))


def macro_loss(losses: DataFrame, loss: str = "loss") -> DataFrame:
    """One row: the mean of the groups' losses, each weighing alike, and how many groups there are."""
    return losses.agg(F.avg(loss).alias("macro_loss"), F.count(F.lit(1)).alias("groups"))


def fused_evaluation(batches: DataFrame, by: list[str], mlm: str, routing: str, weight: str, share: float) -> DataFrame:
    """Means over batches of the masked loss, the routing loss, the first candidate's weight, and of what training minimizes: the first and `share` of the second."""
    return batches.groupBy(*by).agg(F.avg(mlm).alias("mlm_loss"), F.avg(routing).alias("routing_loss"), F.avg(weight).alias("reference_weight"), F.avg(total_loss(F.col(mlm), F.col(routing), share)).alias("total_loss"))


def total_loss(mlm: Column, routing: Column, share: float) -> Column:
    """The masked loss and `share` of the routing loss."""
    return mlm + F.lit(float(share)) * routing


def epoch_loss(steps: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """(epoch, loss, steps): the mean of each epoch's losses."""
    return steps.groupBy(epoch).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("steps"))


def accumulated(batches: DataFrame, steps: int, batch: str, loss: str, right: str, masked: str, tokens: str, sequences: str | None = None) -> DataFrame:
    """Measures of each optimizer step of so many batches, with the tokens, and sequences if there is a count of them, up to it.

    There are as many steps as the corpus has batches: what comes before a step is added up by ranges (`order.ranked`), not in one task.
    """
    from .order import ranked

    step = batches.groupBy(F.floor(F.col(batch) / steps).cast("long").alias("step")).agg(
        F.avg(loss).alias("loss"), (F.sum(right) / F.greatest(F.sum(masked), F.lit(1))).alias("masked_accuracy"), F.sum(tokens).cast("long").alias("tokens"), F.count(F.lit(1)).alias("microbatches"),
        *([F.sum(sequences).cast("long").alias("sequences")] if sequences else []),
    )
    out = step.withColumn("_all", F.lit(0))
    for counted in ("tokens", *(["sequences"] if sequences else [])):
        out = ranked(out, "_all", "step", counted).drop("nth").withColumnRenamed("running", f"{counted}_so_far")
    return out.drop("_all")


def entropy(shares: Column, least: float = 1e-8) -> Column:
    """-sum p ln p of an array, p not below `least` in the logarithm."""
    return F.aggregate(F.transform(shares, lambda p: -p * F.ln(F.greatest(p, F.lit(least)))), F.lit(0.0), lambda a, x: a + x)


def mean_vector(rows: DataFrame, vector: str, by: list[str], mask: str | None = None) -> DataFrame:
    """(…, dim, value): mean of the vectors by dimension; of those only that the mask tells."""
    chosen = rows if mask is None else rows.where(F.col(mask))
    return chosen.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def looked_up(rows: DataFrame, ids: str, table: DataFrame, key: str, vector: str, by: list[str]) -> DataFrame:
    """(…, dim, total, tokens): the sum of the vectors of all ids in the lists of a group, and how many ids there are.

    What comes of an id is the same for each occurrence, so that ids are counted
    before they meet their vectors, and vectors are opened last.
    """
    counts = materialize(rows.select(*by, F.explode(ids).alias(key)).groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n")))  # asked for twice
    met = counts.join(few(table.select(key, vector), counts, key), key)
    # the vectors of a group come together whole, and are opened where they are added up
    sums = met.groupBy(*by).agg(F.sum("_n").cast("long").alias("tokens"), F.sort_array(F.collect_list(F.struct(key, "_n", F.col(vector).alias("_v")))).alias("_met"))
    return sums.select(*by, "tokens", F.posexplode(weighted_sum("_met", "_n", "_v")).alias("dim", "total"))


#: Vectors asked for, up to which they are handed to all tasks.
MOST_HANDED_OUT = 1 << 14


def few(table: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows of a table of vectors that `asked` has keys of, handed to all tasks if they are few: a key that very many rows have isn't one task's then."""
    wanted = asked.select(key).distinct().limit(MOST_HANDED_OUT + 1)
    if wanted.count() > MOST_HANDED_OUT:
        return table
    return F.broadcast(table.join(F.broadcast(wanted), key, "left_semi"))


def weighted_sum(rows: str | Column, weight: str, vector: str) -> Column:
    """The sum of the vectors in a list of structs, each times its weight, in the order of the list."""
    added = lambda so_far, x: F.zip_with(so_far, x[vector], lambda a, v: a + x[weight] * v.cast("double"))
    none = F.transform(F.element_at(rows, 1)[vector], lambda _: F.lit(0.0))
    return F.aggregate(rows, none, added)


def argmax(values: Column) -> Column:
    """Place from 0 of the first largest number of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax of the label's logit, null where the label is ignored; the largest logit is taken off first."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp((x - top).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    own = F.element_at(logits, label.cast("int") + 1)
    return F.when(label != IGNORED, F.ln(total) + (top - own).cast("double"))


def shared_metrics(first: DataFrame, second: DataFrame, name: str = "metric", left_out: tuple[str, ...] = ("labeled_tokens",)) -> DataFrame:
    """Names of the metrics that both have, without counts."""
    return first.select(name).intersect(second.select(name)).where(~F.col(name).isin(*left_out))
