"""Near copies by the Jaccard similarity of word shingles: SimHash by an index of positional bytes, pairs verified on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import settle, slices
from .simhash import SEED, keep_least, meeting, rooted, wide

#: Words of a shingle, and the share of two documents' shingles that near copies have in common at least.
SHINGLE, LEAST = 5, 0.8
#: Lists in which neighbours are looked at first, of those of the index.
FIRST = 16
#: Places apart in a list, in an order of its band's own, at which pairs are looked at first.
NEIGHBOURS = 2
#: Bits of a set's sketch.
SKETCH = 2048


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once and in order; words as `simhash.fingerprint` has them (fewer: all as one)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))  # where the next word starts
    pieces = zip([0, *ends[:-shingle]], ends[shingle - 1 :], strict=True)
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in pieces), np.uint64, len(words) - shingle + 1))


def set_key(hashes: np.ndarray) -> int:
    """A signed long for the whole set: equal sets have equal keys. No shingles: 0."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def text_key(text: str | None) -> int:
    """`set_key` of a text's shingles."""
    return set_key(shingles(text))


def sketch(hashes: np.ndarray) -> bytes:
    """For each of `SKETCH` places whether an odd number of hashes falls on it.

    Two sketches differ in no more places than their sets have elements that
    aren't common: a bound that is never wrong, and close to that number.
    """
    counts = np.bincount((hashes >> np.uint64(53)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def may_be_near(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches (rows of 64-bit numbers) with so many elements in both sets together may have a similarity of `LEAST`.

    At 0.8 a ninth of both sets' elements aren't common, at most.
    """
    return 9 * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= sizes


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, size, bits, sketch): each document's set key, how many shingles it has, their SimHash and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())], ["doc_id", "fp", "size", "bits", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long, size long, bits binary, sketch binary")


def _pairs(batches: Iterator[pa.RecordBatch], near: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) within lists that sizes and sketches allow, and whose roots differ; lists come one after another, by size within.

    near: those at most `NEIGHBOURS` apart in an order of the list's own; all
    otherwise. Only pairs that may be near copies leave the task.
    """
    rest: tuple[np.ndarray, ...] | None = None
    done, batches = False, iter(batches)
    while not done:
        batch = next(batches, None)
        done = batch is None
        if done:
            new = (*(np.empty(0, np.int64) for _ in range(5)), np.empty((0, SKETCH // 64), np.uint64))
        else:
            whole = b"".join(x.as_py() for x in batch.column(5))
            new = (*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)), np.frombuffer(whole, np.uint64).reshape(-1, SKETCH // 64))
        band, key, size, fp, root, bits = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new, strict=True))
        if not len(fp):
            rest = None
            continue
        number = np.concatenate([[0], np.cumsum((band[1:] != band[:-1]) | (key[1:] != key[:-1]))])
        cut = len(fp) if done else int(np.searchsorted(number, number[-1]))
        rest = (band[cut:], key[cut:], size[cut:], fp[cut:], root[cut:], bits[cut:])
        if not cut:
            continue
        if near:  # an order that differs from band to band, so that each has other neighbours
            mixed = (fp[:cut].view(np.uint64) ^ key[:cut].view(np.uint64) ^ band[:cut].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
            order = np.lexsort((mixed, number[:cut]))
            size, fp, root, bits = size[:cut][order], fp[:cut][order], root[:cut][order], bits[:cut][order]
        starts = np.flatnonzero(np.concatenate([[True], number[1:cut] != number[: cut - 1]]))
        differ = np.minimum.reduceat(root[:cut], starts) != np.maximum.reduceat(root[:cut], starts)
        at, step = np.flatnonzero(differ[number[:cut]]), 0
        while len(at) and not (near and step == NEIGHBOURS):
            step += 1
            at = at[at + step < cut]
            at = at[number[at] == number[at + step]]
            if not near:
                at = at[size[at] >= LEAST * size[at + step]]  # sizes only grow from here on
            for i in range(0, len(at), 1 << 16):
                some = at[i : i + (1 << 16)]
                some = some[root[some] != root[some + step]]
                some = some[may_be_near(bits[some], bits[some + step], size[some] + size[some + step])]
                if len(some):
                    a, b = fp[some], fp[some + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, x, y) the pairs whose sets x and y are as similar as `LEAST`."""
    for batch in batches:
        kept = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(5 * both >= 4 * (len(x) + len(y) - both))  # LEAST as whole numbers
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))


def links(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between the set keys of documents that join near copies as all pairs would.

    A group of many near copies has pairs in the square of its size. Neighbours
    in some lists are verified first, then all pairs of all lists that those
    haven't joined: a pair is left out only if it changes no component, or if
    its sketches show that it is none of near copies.
    """
    classes = settle(marked.where("size > 0").groupBy("fp").agg(F.min("size").alias("size"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")))
    met = settle(meeting(classes.where("size > 3")))  # less than four are at 0.8 only if they are equal
    wanted = settle(met.select("fp").distinct())
    facts = settle(classes.select("fp", "size", "sketch").join(wanted, "fp"))
    ids = classes.join(wanted, "fp", "left_semi").select(F.col("least").alias("_least")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 0)):
            sets = [shingles(x.as_py()) for x in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "hashes"])

    texts = docs.join(ids, F.col(id_col).eqNullSafe(F.col("_least")), "left_semi").select(F.col(text_col).alias("text"))
    sets = settle(texts.mapInArrow(run, "fp long, hashes array<long>").join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))

    def verified(rooted_lists: DataFrame, near: bool) -> DataFrame:
        rows = rooted_lists.join(facts, "fp").select("band", "key", "size", "fp", "root", "sketch").repartition("band", "key").sortWithinPartitions("band", "key", "size", "fp")
        pairs = settle(rows.mapInArrow(lambda batches: _pairs(batches, near), "a long, b long").distinct())
        with_a = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a")
        both = with_a.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
        return settle(both.mapInArrow(_verified, "a long, b long"))

    first = verified(met.where(F.col("band") < FIRST).withColumn("root", F.col("fp")), True)
    stars = components(first).withColumnRenamed("node", "fp")
    told = settle(met.join(stars, "fp", "left").select("band", "key", "fp", F.coalesce("root", "fp").alias("root")))
    apart = told.groupBy("band", "key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    return first.union(verified(told.join(apart.select("band", "key"), ["band", "key"], "left_semi"), False))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with one document of each group of near copies: that of the least id.

    Near copies are documents whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, and what they reach. Documents of equal sets are
    one class; classes are found by SimHash through its index of positional
    bytes (`simhash.meeting`), and pairs that meet are verified on their whole
    sets, so that no link is wrong and two in a hundred thousand pairs at 0.8
    are lost at most. Texts without words, null ones too, are one class; texts of any length are read whole; repeated rows are exact
    copies; an empty table gives no rows; other columns may have any names.
    """
    marked = settle(_marked(docs, id_col, text_col))
    grouped = settle(rooted(marked.select("doc_id", "fp"), components(links(docs, marked, id_col, text_col))))
    return keep_least(docs, grouped, id_col, text_col, text_key)
