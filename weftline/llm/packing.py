"""Packing documents into fixed-length sequences: dominance reduction, then best fit, on a table of lengths."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Tokens of a sequence.
CAPACITY = 2048
#: Id that follows a document's own.
END_ID = 0


@functools.lru_cache(maxsize=2)
def _encoder(source: str):
    """The library's vocabulary in an encoder that is several times as fast, with the same ids; and the library for what it refuses."""
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(source)
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    library = Tokenizer.from_str(source)
    library.no_truncation()
    library.no_padding()

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its patterns give up on very long white space
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end id.

    Only documents of more than `capacity` tokens are cut, into pieces of that
    many; the first takes what is over. Null and empty texts are the end id
    alone; repeated rows and null ids each have their pieces; a text of any
    length is encoded whole, by one task; an empty table gives no rows; other
    columns are ignored.
    """
    from .bpe import default_path

    held = docs.sparkSession.sparkContext.broadcast(open(path or default_path(), encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(held.value)
        for batch in batches:
            place, piece, start, length, crc = [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                ids = np.append(encode(x.as_py() or "").astype("<u4"), np.uint32(END_ID)).astype("<u4", copy=False)
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    place.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def reduce_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction on counts of lengths; takes what it fixes out of `counts`.

    Returns (lengths of a sequence, how many such sequences). For each length,
    longest first, a set with it that dominates all others with it is fixed:
    alone if nothing fits beside it; with the longest that fits if that fills
    the sequence, if no two fit, or if any two that fit are no longer together;
    with the longest that fits and the longest that then fits, if no three fit
    and any two that fit beside it are matched one by one, or lie in the first.
    Some best packing has every set so fixed, so none is made worse.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def have() -> list[int]:
        return sorted(k for k, n in counts.items() if n > 0)

    def take(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        fixed.append((lengths, times))

    for size in reversed(have()):
        while counts[size] > 0:
            room = capacity - size
            counts[size] -= 1
            left = have()
            smallest = [x for x in left for _ in range(min(3, counts[x]))][:3]
            fits = [x for x in left if x <= room]
            best = fits[-1] if fits else None
            second = None
            dominated = best is None or best == room or len(smallest) < 2 or smallest[0] + smallest[1] > room
            if not dominated and (len(smallest) < 3 or sum(smallest) > room):
                pair = _longest_pair(fits, counts, room)
                if pair <= best:
                    dominated = True
                else:
                    counts[best] -= 1
                    beside = [x for x in fits if x <= room - best and counts[x] > 0]
                    counts[best] += 1
                    if beside and _longest_pair([x for x in fits if x > beside[-1]], counts, room) <= best:
                        dominated, second = True, beside[-1]
            counts[size] += 1
            if not dominated:
                break
            take(*(x for x in (size, best, second) if x is not None))
    return fixed


def _longest_pair(lengths: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum up to `room` of two of `lengths` (ascending), 0 if there is none."""
    low, high, best = 0, len(lengths) - 1, 0
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room or low == high and counts[lengths[low]] < 2:
            high -= 1
            continue
        best = max(best, total)
        low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int, first: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit, longest first, of many equal lengths at once: (length, how many, sequence of the first, offset), next free sequence.

    Each entry puts one piece into each of a run of neighbouring sequences.
    """
    placed: list[tuple[int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)

    def put(size: int, begin: int, many: int, each: int, room: int) -> None:
        """`each` pieces into each of `many` sequences with that room."""
        placed.extend((size, many, begin, capacity - room + k * size) for k in range(each))
        if many:
            runs.setdefault(room - each * size, []).append((begin, many))

    for size in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in runs if r >= size), default=None)
            # the sequence that one piece went to has the least room for the next one too, so each is filled up
            each = (capacity if room is None else room) // size
            if room is None:
                begin, many, room = first, -(-n // each), capacity
                first += many
            else:
                begin, many = runs[room].pop()
                if not runs[room]:
                    del runs[room]
            full = min(many, n // each)
            over = min(n - full * each, each - 1) if full < many else 0
            if full:
                put(size, begin, full, each, room)
            if over:
                put(size, begin + full, 1, over, room)
            if (unused := many - full - (over > 0)) > 0:
                runs.setdefault(room, []).append((begin + full + (over > 0), unused))
            n -= full * each + over
    return placed, first


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go: rows (length, rank of the first, sequence of the first, offset), and the number of sequences.

    A row holds for the ranks up to the next row of that length; each next rank
    goes to the next sequence. The plan has to do with lengths only, so that
    its size is bounded by `capacity` whatever the number of documents.
    """
    left = dict(counts)
    entries: list[tuple[int, int, int, int]] = []
    first = 0
    for lengths, times in reduce_lengths(left, capacity):
        at = 0
        for x in lengths:
            entries.append((x, times, first, at))
            at += x
        first += times
    rest, first = best_fit(left, capacity, first)
    rank: dict[int, int] = {}
    rows = []
    for size, many, begin, offset in entries + rest:
        rows.append((size, rank.get(size, 0), begin, offset))
        rank[size] = rank.get(size, 0) + many
    assert rank == {k: n for k, n in counts.items() if n}, "every piece has one place"
    return np.array(sorted(rows), np.int64).reshape(-1, 4), first


def assign(lengths: np.ndarray, ranks: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank, from the rows of `plan`."""
    at = np.searchsorted(rows[:, 0] << 40 | rows[:, 1], lengths << 40 | ranks, side="right") - 1
    return rows[at, 2] + ranks - rows[at, 1], rows[at, 3]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (length 1 to `capacity`, any other columns) with sequence_id and offset.

    The counts of the lengths, `capacity` numbers at most, go to the driver,
    which fixes dominating sets, fits the rest, and returns a plan by length
    and rank. Ranks come from counts by task and length, so that a length that
    a third of the pieces have isn't ranked in one task.
    """
    marked = settle(cut.withColumn("task_id", F.spark_partition_id()))
    table = settle(marked.groupBy("task_id", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    held = cut.sparkSession.sparkContext.broadcast(rows)  # bounded by capacity
    before = Window.partitionBy("length").orderBy("task_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select(F.col("task_id").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).hint("merge")  # grows with tasks
    inside = Window.partitionBy("task_id", "length").orderBy(*[F.col(c) for c in cut.columns if c != "length"])
    ranked = (
        marked.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, (F.col("task_id") == F.col("t")) & (F.col("length") == F.col("l")))
        .select(*cut.columns, (F.col("nth") + F.col("ahead")).alias("rank"))
    )
    names = cut.columns
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = assign(batch.column(at).to_numpy(), batch.column(len(names)).to_numpy(), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their sequence and place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text counts as empty and is a piece of the end id alone; repeated
    rows and null ids are packed like any other; an empty table gives no rows;
    other columns are ignored.
    """
    return pack(pieces(docs, path, capacity, id_col, text_col), capacity)
