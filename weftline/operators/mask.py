"""Masked prediction: which tokens are hidden and what takes their place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from ..functions.text import hash_number, hash_numbers, in_slices
from .metrics import IGNORED


def replacement(u: Column, token: Column, mask_id: int, vocabulary: int, r: Column) -> Column:
    """Eight in ten become the mask, one in ten any id, one in ten stays."""
    return F.when(u < 0.8, F.lit(mask_id)).when(u < 0.9, F.floor(r * vocabulary).cast("int")).otherwise(token)


def mask_tokens(tokens: DataFrame, by: list[str], seed: int, share: float, mask_id: int, vocabulary: int, special: str | None = None) -> DataFrame:
    """Tokens (`by`, pos, token) with masked, decision, input_id and label.

    Each number is a function of seed, key and place, so that a token's fate
    depends on no order of work. A sequence of which chance hides nothing has
    its first token that may be hidden hidden. The label is the token where it
    is hidden, else IGNORED.
    """
    may = F.lit(True) if special is None else ~F.col(special)
    key = [F.col(c) for c in (*by, "pos")]
    number = lambda kind: hash_number(f"{seed}|{kind}", *key)
    drawn = tokens.withColumn("_may", may).withColumn("_hit", F.col("_may") & (number("mask") < share))
    whole = Window.partitionBy(*by)
    first = F.min(F.when(F.col("_may"), F.col("pos"))).over(whole)
    drawn = drawn.withColumn("masked", F.col("_hit") | (~F.max("_hit").over(whole) & F.col("_may") & (F.col("pos") == first)))
    drawn = drawn.withColumn("decision", number("replace"))
    put = replacement(F.col("decision"), F.col("token"), mask_id, vocabulary, number("token"))
    return drawn.withColumn("input_id", F.when(F.col("masked"), put).otherwise(F.col("token"))).withColumn("label", F.when(F.col("masked"), F.col("token")).otherwise(F.lit(IGNORED))).drop("_may", "_hit")


def mask_lists(rows: DataFrame, ids: str, key: str, seed: int, share: float, mask_id: int, vocabulary: int, special: str | None = None, into: str = "masking") -> DataFrame:
    """`mask_tokens` on a list of ids in each row, with the same numbers for the same key: `into` is a list of (masked, decision, input_id, label).

    special: a list of booleans, true where a token may not be hidden. Nothing
    leaves its row. The numbers are drawn in Python: Spark's functions of lists
    aren't compiled, and each draw of theirs took several microseconds.
    """
    special_of = F.transform(ids, lambda _: F.lit(False)) if special is None else F.col(special)
    token = rows.schema[ids].dataType.elementType
    numbers, kind = pa.int64() if token.typeName() == "bigint" else pa.int32(), StructType([StructField("masked", BooleanType()), StructField("decision", DoubleType()), StructField("input_id", token), StructField("label", token)])

    @in_slices(ArrayType(kind))
    def masking(keys: pa.Array, tokens: pa.Array, specials: pa.Array) -> pa.Array:
        counts = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
        ends = np.cumsum(counts)
        flat, may = np.asarray(tokens.flatten(), np.int64), ~np.asarray(specials.flatten(), bool)
        if len(flat) != len(may):
            raise ValueError("tokens and special marks must be as many")
        masked, decision, put = np.zeros(len(flat), bool), np.zeros(len(flat)), flat.copy()
        for k, (name, n) in enumerate(zip(keys.to_pylist(), counts.tolist(), strict=True)):
            if not n:
                continue
            own = slice(int(ends[k]) - n, int(ends[k]))
            said = lambda what, at: hash_numbers("|".join([f"{seed}|{what}", *([] if name is None else [name])]), at)  # noqa: B023, E731
            open_ = np.flatnonzero(may[own])
            hit = open_[said("mask", open_) < share]
            hit = hit if len(hit) else open_[:1]
            u = said("replace", np.arange(n))
            masked[own][hit], decision[own] = True, u
            other = hit[(u[hit] >= 0.8) & (u[hit] < 0.9)]
            put[own][hit[u[hit] < 0.8]] = mask_id
            put[own][other] = np.floor(said("token", other) * vocabulary).astype(np.int64)
        told = [pa.array(masked), pa.array(decision), pa.array(put, numbers), pa.array(np.where(masked, flat, IGNORED), numbers)]
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32(), mask=np.append(np.asarray(tokens.is_null()), False) if tokens.null_count else None)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(told, ["masked", "decision", "input_id", "label"]))

    return rows.withColumn(into, masking(F.col(key).cast("string"), F.col(ids), special_of))


def mask_candidates(ids: Column, met: Column, key: Column, candidate: Column, seed: int, mask_id: int, vocabulary: int) -> Column:
    """A list of (input_id, label) of a candidate's tokens: one that overlaps a hidden reference token takes the decision of the first such.

    met: for each token the place of that one, -1 for none, and its decision
    (`align.first_overlaps`). An id by chance is drawn for each candidate token,
    and no other segmentation shows what is hidden.
    """
    number = lambda pos: hash_number(f"{seed}|candidate", key, candidate, pos)
    put = lambda x, pos: replacement(x["met"]["value"], x["token"], mask_id, vocabulary, number(pos))
    hidden = lambda x, pos: F.struct(F.when(x["met"]["place"] >= 0, put(x, pos)).otherwise(x["token"]).alias("input_id"), F.when(x["met"]["place"] >= 0, x["token"]).otherwise(F.lit(IGNORED)).alias("label"))
    return F.transform(F.arrays_zip(ids.alias("token"), met.alias("met")), hidden)


def pad(rows: DataFrame, batch: str, ids: str, pad_id: int = 1, labels: str | None = None, spans: str | None = None) -> DataFrame:
    """`rows` with input_ids, attention_mask, and labels and spans if they are named, as long as the longest of their batch: ids with `pad_id`, labels with IGNORED, spans with (-1, -1)."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    gap = longest - F.size(ids)
    out = rows.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)))
    for name, column, fill in ((ids, "input_ids", F.lit(pad_id)), (labels, "labels", F.lit(IGNORED)), (spans, "spans", F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))):
        if name:
            kind = rows.schema[name].dataType.simpleString()
            out = out.withColumn(f"_{column}", F.concat(F.col(name), F.array_repeat(fill, gap).cast(kind)))
    for column in ("input_ids", "labels", "spans"):
        if f"_{column}" in out.columns:
            out = out.withColumn(column, F.col(f"_{column}")).drop(f"_{column}")
    return out


def wrap(ids: Column, longest: int, begin: int = 0, end: int = 2) -> Column:
    """The first ids with the begin and end marks around them, `longest` in all at most."""
    return F.concat(F.array(F.lit(begin)), F.slice(ids, 1, longest - 2), F.array(F.lit(end)))
