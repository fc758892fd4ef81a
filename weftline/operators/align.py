"""Spans that overlap: edges, projected vectors, transferred labels, propagated masks.

Two segmentations of one text are two lists in one row: the functions on lists
match them where they are, without a shuffle. Tables of spans that come from
different places are joined by `overlaps`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import in_slices, runs
from .metrics import IGNORED

SPANS = "array<struct<start:int,end:int>>"
_EDGE = StructType([StructField("l_pos", IntegerType()), StructField("r_pos", IntegerType()), StructField("weight", IntegerType())])


def valid_span(start: str = "start", end: str = "end") -> Column:
    """Whether a span is of real characters; (-1, -1) marks what has none."""
    return (F.col(start) >= 0) & (F.col(end) > F.col(start))


class Spans:
    """The span lists of a batch in one row of numbers: the row, place, start and end of each, and where each row's begin."""

    def __init__(self, lists: pa.Array):
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        self.rows, self.counts, self.offsets = len(lists), counts, np.concatenate([[0], np.cumsum(counts)])
        flat = lists.flatten()
        self.start, self.end = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
        self.row = np.repeat(np.arange(self.rows), counts)
        self.place = np.arange(len(self.row)) - np.repeat(self.offsets[:-1], counts)
        self.real = (self.start >= 0) & (self.end > self.start)


def edges(left: Spans, right: Spans, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, common characters) of all real spans that overlap, as places in the batch, by left and right.

    The right spans of a row are ordered by where they start; those that end
    behind a left span's start, and start before its end, are a run between two
    bounds that a binary search finds. `keep` leaves out right spans.
    """
    chosen = np.flatnonzero(right.real if keep is None else right.real & keep)
    chosen = chosen[np.lexsort((right.start[chosen], right.row[chosen]))]
    wide = np.int64(1) << 40  # no text is as long
    starts = right.row[chosen] * wide + right.start[chosen]
    reach = np.maximum.accumulate(right.row[chosen] * wide + right.end[chosen])  # the furthest end so far
    mine = np.flatnonzero(left.real)
    low = np.searchsorted(reach, left.row[mine] * wide + left.start[mine], side="right")
    high = np.searchsorted(starts, left.row[mine] * wide + left.end[mine], side="left")
    n = np.maximum(high - low, 0)
    a = np.repeat(mine, n)
    b = chosen[np.repeat(low, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
    weight = np.minimum(left.end[a], right.end[b]) - np.maximum(left.start[a], right.start[b])
    met = (weight > 0) & (left.row[a] == right.row[b])
    order = np.lexsort((b[met], a[met]))
    return a[met][order], b[met][order], weight[met][order]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


@in_slices(ArrayType(_EDGE))
def overlap_edges(left: pa.Array, right: pa.Array) -> pa.Array:
    """(l_pos, r_pos, weight) of the spans of two lists that have characters in common, however many; null lists have none."""
    x, y = Spans(left), Spans(right)
    a, b, weight = edges(x, y)
    told = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (x.place[a], y.place[b], weight)], ["l_pos", "r_pos", "weight"])
    return _lists(np.bincount(x.row[a], minlength=x.rows), told)


def _first(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The first b of each a below n, -1 for none; a and b come in order."""
    out = np.full(n, -1, np.int64)
    at, first = np.unique(a, return_index=True)
    out[at] = b[first]
    return out


@in_slices(ArrayType(StructType([StructField("place", IntegerType()), StructField("value", DoubleType())])))
def first_overlaps(spans: pa.Array, others: pa.Array, keep: pa.Array, values: pa.Array) -> pa.Array:
    """For each span the place of the first of the others that it overlaps and `keep` (booleans) has, and that one's value; -1 and null for none."""
    x, y = Spans(spans), Spans(others)
    kept, told = np.asarray(keep.flatten(), bool), np.asarray(values.flatten(), float)
    if len(kept) != len(y.row) or len(told) != len(y.row):
        raise ValueError("spans, marks and values must be as many")
    a, b, _ = edges(x, y, kept)
    met = _first(a, b, len(x.row))
    none = met < 0
    place, value = (np.where(none, -1, v[met]) if len(v) else np.full(len(met), -1.0) for v in (y.place, told))
    return _lists(x.counts, pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(value, pa.float64(), mask=none)], ["place", "value"]))


@in_slices(ArrayType(IntegerType()))
def labels_of(tokens: pa.Array, words: pa.Array, labels: pa.Array) -> pa.Array:
    """Each token's label: that of the first word it overlaps, if no token before has got it; else IGNORED."""
    x, y = Spans(tokens), Spans(words)
    if len(labels.flatten()) != len(y.row):
        raise ValueError("words and labels must be as many")
    a, b, _ = edges(x, y)
    word = _first(a, b, len(x.row))
    taken = np.flatnonzero(word >= 0)
    _, first = np.unique(word[taken], return_index=True)
    out = np.full(len(x.row), IGNORED, np.int64)
    given = taken[first]
    out[given] = np.asarray(labels.flatten(), np.int64)[word[given]]
    return _lists(x.counts, pa.array(out, pa.int32()))


#: Bytes of a vector table that is handed to all tasks: a model's, which its vocabulary bounds. Larger ones are joined.
MOST_TABLE_BYTES = 256 << 20


def vector_table(vectors: DataFrame, key: str, vector: str) -> np.ndarray:
    """The vectors of a table in the order of their keys, as a matrix; an error if it is larger than `MOST_TABLE_BYTES`."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).first()
    if n["n"] * (n["width"] or 0) * 8 > MOST_TABLE_BYTES:
        raise ValueError("too many vectors to hand out; join them (`project`)")
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).toArrow().sort_by(key)
    return np.asarray(rows["v"].combine_chunks().flatten(), float).reshape(len(rows), -1)


#: Vectors of spans that a task works out at once; a longer text is alone.
MOST_VECTORS = 1 << 14


def projected(x: Spans, y: Spans, of_x: np.ndarray, of_y: np.ndarray) -> np.ndarray:
    """Each reference token's mean of the candidate tokens that overlap it, by common characters; its own vector where none does."""
    a, b, weight = edges(x, y)
    total = np.bincount(b, weight, minlength=len(y.row))
    out = np.zeros_like(of_y)
    for dim in range(of_y.shape[1]):
        out[:, dim] = np.bincount(b, weight * of_x[a, dim], minlength=len(y.row))
    return np.where(total[:, None] > 0, out / np.maximum(total, 1)[:, None], of_y)


def project_rows(rows: DataFrame, table: np.ndarray, key: str, candidate: str, candidate_ids: str, reference: str, reference_ids: str, pooled: bool = False) -> DataFrame:
    """(key, vectors): the projected vector of each reference token of a row; pooled: their mean over the row, zeros for no tokens.

    candidate, reference: lists of spans; …_ids: lists of places in `table`, a
    vector for each span. Everything of a text is in its row, and stays there.
    """
    held = rows.sparkSession.sparkContext.broadcast(table)  # `vector_table` bounds it
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(whole.column(k)), 0), np.int64) for k in (1, 3))
            for at, n in runs(sizes, MOST_VECTORS, 16):
                batch = whole.slice(at, n)
                x, y = Spans(batch.column(1)), Spans(batch.column(3))
                of_x, of_y = (held.value[np.asarray(batch.column(k).flatten(), np.int64)] for k in (2, 4))
                out = projected(x, y, of_x, of_y)
                if pooled:
                    sums = np.stack([np.bincount(y.row, out[:, dim], minlength=y.rows) for dim in range(out.shape[1])], axis=1)
                    out, counts = sums / np.maximum(y.counts, 1)[:, None], None
                else:
                    counts = y.counts
                each = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), each if counts is None else _lists(counts, each)], [key, "vectors"])

    names = [F.col(c).cast(SPANS) if c in (candidate, reference) else F.col(c).cast("array<long>") for c in (candidate, candidate_ids, reference, reference_ids)]
    return rows.select(key, *names).mapInArrow(run, f"`{key}` {kind}, vectors array<{'double' if pooled else 'array<double>'}>")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: int = 16) -> DataFrame:
    """Pairs of spans with common characters, and how many (`weight`).

    left and right: `by`, start, end and columns of their own; left's come as
    l_… , right's as r_… . Spans are put into every cell of `width` characters
    that they touch, so that the join is one of equal (by, cell) with a short
    list on either side, however long a text is. A pair that meets in several
    cells counts in the first.
    """
    def cells(rows: DataFrame, side: str) -> DataFrame:
        named = rows.where(valid_span()).select(*by, *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in by))
        first = F.floor(F.col(f"{side}_start") / width)
        return named.withColumn("_cell", F.explode(F.sequence(first, F.floor((F.col(f"{side}_end") - 1) / width))))

    met = cells(left, "l").join(cells(right, "r"), [*by, "_cell"]).where((F.col("l_start") < F.col("r_end")) & (F.col("l_end") > F.col("r_start")))
    once = met.where(F.col("_cell") == F.floor(F.greatest("l_start", "r_start") / width)).drop("_cell")
    return once.withColumn("weight", (F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).cast("long"))


def project(edges: DataFrame, vectors: DataFrame, reference: DataFrame, by: list[str], candidate: str = "l_pos", place: str = "r_pos") -> DataFrame:
    """(…, place, dim, value): each reference token's mean of the candidate tokens that overlap it, by common characters.

    vectors: `by`, pos, vector of candidate tokens; reference: `by`, pos, vector
    of reference tokens, whose own vector stands in where nothing overlaps.
    """
    parts = edges.join(vectors.select(*by, F.col("pos").alias(candidate), F.posexplode("vector").alias("dim", "x")), [*by, candidate])
    sums = parts.groupBy(*by, place, "dim").agg((F.sum(F.col("weight") * F.col("x").cast("double")) / F.sum("weight")).alias("mean"))
    own = reference.select(*by, F.col("pos").alias(place), F.posexplode("vector").alias("dim", "own"))
    return own.join(sums, [*by, place, "dim"], "left").select(*by, place, "dim", F.coalesce("mean", F.col("own").cast("double")).alias("value"))


def transfer_labels(tokens: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """(…, pos, label): each token gets the label of the first word that it overlaps, if no token before has got it; else IGNORED.

    tokens: `by`, pos, start, end. words: `by`, idx, start, end, label.
    """
    first = overlaps(tokens, words, by).groupBy(*by, F.col("l_pos").alias("pos")).agg(F.min_by(F.struct("r_idx", "r_label"), F.col("r_idx")).alias("word"))
    nth = F.row_number().over(Window.partitionBy(*by, "word.r_idx").orderBy("pos"))
    given = first.withColumn("_nth", nth).where("_nth = 1").select(*by, "pos", F.col("word.r_label").alias("label"))
    return tokens.select(*by, "pos").join(given, [*by, "pos"], "left").select(*by, "pos", F.coalesce("label", F.lit(IGNORED)).alias("label"))


def propagate_masks(candidates: DataFrame, masked: DataFrame, by: list[str]) -> DataFrame:
    """Candidate tokens that overlap a masked reference token, with the decision of the first such (`decision`).

    candidates: `by`, candidate, pos, start, end. masked: `by`, pos, start, end, decision.
    """
    met = overlaps(candidates, masked, by)
    return met.groupBy(*by, F.col("l_candidate").alias("candidate"), F.col("l_pos").alias("pos")).agg(F.min_by("r_decision", "r_pos").alias("decision"), F.min("r_pos").alias("reference_pos"))


def spans_in_order(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens that no candidate may have: a span without characters that isn't (-1, -1), or one that begins before the one before."""
    real = tokens.where((F.col("start") != -1) | (F.col("end") != -1))
    before = F.lag("start").over(Window.partitionBy(*by).orderBy("pos"))
    return real.withColumn("_before", before).where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("_before") > F.col("start"))).drop("_before")


@in_slices(IntegerType())
def disordered(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """How many tokens of each list `spans_in_order` would tell, where the lists are in one row."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(starts), 0), np.int64)
    a, b = (np.asarray(x.flatten(), np.int64) for x in (starts, ends))
    row = np.repeat(np.arange(len(counts)), counts)
    real = (a != -1) | (b != -1)
    a, b, row = a[real], b[real], row[real]
    back = np.concatenate([[False], (a[:-1] > a[1:]) & (row[:-1] == row[1:])])[: len(a)]
    return pa.array(np.bincount(row[(a < 0) | (b <= a) | back], minlength=len(counts)), pa.int32())
