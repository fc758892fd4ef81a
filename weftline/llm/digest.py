"""Quartile bucket digests of byte triplets, compared with a bounded difference."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import BATCH_BYTES, settle, slices

#: Buckets that triplets are counted in, two bits each in a digest.
BUCKETS = 1024
#: Places of the three bytes in a window of five.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]
#: What quartiles apart add to the difference; unlike quartiles apart by chance come to 13/8 a bucket.
APART = np.array([0, 1, 2, 6], np.int64)
#: The difference beyond which digests count as wholly unlike.
BOUND = BUCKETS * 13 // 8
#: Length codes grow by one for each tenth more bytes; a step adds so much, up to half the buckets.
LENGTH_BASE, LENGTH_STEP = math.log(1.1), BUCKETS // 32

_CHUNK = 1 << 20


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """How many triplets of the bytes fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(data), _CHUNK):
        b = data[at : at + _CHUNK + 4].astype(np.uint32)
        first = np.multiply(b, np.uint32(0x9E3779B1))
        second, third = b * np.uint32(0x85EBCA77), b * np.uint32(0xC2B2AE3D)
        for salt, (i, j, k) in enumerate(TRIPLETS):
            n = min(len(b) - k, _CHUNK)
            if n <= 0:
                continue
            h = first[i : i + n] ^ second[j : j + n] ^ third[k : k + n] ^ np.uint32(salt * 0x27D4EB2F)
            h *= np.uint32(0x165667B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> shift, minlength=BUCKETS)
    return counts


class Digest:
    """The quartile of each bucket's count among all, and the length."""

    __slots__ = ("quartiles", "length")

    def __init__(self, quartiles: np.ndarray, length: int):
        self.quartiles, self.length = quartiles, length

    @classmethod
    def of(cls, text: str) -> Digest:
        data = np.frombuffer(text.encode(), np.uint8)
        counts = bucket_counts(data)
        at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]
        cuts = np.partition(counts, at)[at]
        return cls((counts[:, None] > cuts).sum(axis=1).astype(np.uint8), min(255, int(math.log(len(data)) / LENGTH_BASE) + 1) if len(data) else 0)

    def __bytes__(self) -> bytes:
        """The length code, then four buckets in each byte."""
        four = self.quartiles.reshape(-1, 4)
        return bytes([self.length]) + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()

    def __str__(self) -> str:
        return bytes(self).hex()

    @classmethod
    def parse(cls, text: str) -> Digest:
        raw = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
        return cls(np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=1).ravel(), int(text[:2], 16))


def difference(a: Digest, b: Digest) -> int:
    """0 for equal digests, BOUND at most."""
    apart = np.bincount(np.abs(a.quartiles.astype(np.int8) - b.quartiles.astype(np.int8)), minlength=4)
    return min(BOUND, int(apart @ APART) + min(BUCKETS // 2, abs(a.length - b.length) * LENGTH_STEP))


def likeness(a: Digest, b: Digest) -> float:
    """1 for equal digests, 0 for wholly unlike ones."""
    return 1 - difference(a, b) / BOUND


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each whole text; null counts as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(Digest.of(x.as_py() or "")) for x in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


_FIELDS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def _compared(text: str, own: Digest, follower: str, follows: Digest) -> tuple:
    cut = len(text) // 3
    edited = text[: len(text) - cut] + follower[:cut]
    changed = Digest.of(edited)
    return len(text), hashlib.sha256(edited.encode()).digest(), bytes(own), bytes(changed), likeness(own, changed), likeness(own, follows)


def _ranges(keyed: DataFrame, n: int) -> list[tuple]:
    """The first key of each of at most n ranges of about as many rows, in the order of `compare_with_next`; one key a range goes to the driver."""
    k = F.struct("doc_id", "tie", "salt")
    dealt = keyed.select(k.alias("k")).repartitionByRange(n, F.col("k").desc()).groupBy(F.spark_partition_id()).agg(F.max("k").alias("k"))
    return sorted((_key(*r.k) for r in dealt.collect()), reverse=True)


def _key(doc_id, tie: int, salt: int) -> tuple:  # noqa: ANN001
    """What descending order puts null ids last by."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, tie, salt)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's digest beside that of an edited text and of the next document.

    Documents follow each other by descending id, the first after the last.
    The edited text has its last third replaced by the next document's
    beginning. Keys alone are ranged first, and tell where each range begins;
    texts are compressed once, shuffled once to their ranges, sorted, and
    compared with their neighbours as they pass. The first and last row of
    each range are kept with their texts, and joined by their ranges after.

    Null text counts as empty; rows with equal ids follow each other by a
    checksum of their texts, null ids come last; repeated rows, in whatever
    number, are dealt over ranges by the task that read them; a single row
    follows itself; a text of any length is digested whole, by one task, which
    holds it and its neighbour; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.spark_partition_id().alias("salt"), F.col(text_col).alias("text"))
    starts = _ranges(keyed, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, falling = zstandard.ZstdCompressor(level=3).compress, starts[::-1]
        for batch in batches:
            ids, ties, salts = (batch.column(k).to_pylist() for k in range(3))
            at = [max(0, len(starts) - 1 - bisect.bisect_left(falling, _key(*x))) for x in zip(ids, ties, salts, strict=True)]
            data = pa.array([squeeze((x.as_py() or "").encode()) for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns[:3], data], ["at", "doc_id", "tie", "salt", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        schema = pa.schema([("doc_id", id_type), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.string()), *((n, pa.int64() if k == 0 else pa.float64() if k > 3 else pa.binary()) for k, n in enumerate(_NAMES))])
        rows: list[tuple] = []
        part, own, last, digest = None, None, "", None
        ends = lambda i, first, at, text: (i, first, at, text, *[None] * len(_NAMES))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for at, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                text = unpack(x.as_py()).decode()
                now = digest if digest is not None and text == last else Digest.of(text)
                if at != part:
                    if part is not None:
                        rows.append(ends(own, None, part, last))
                    rows.append(ends(i, at, None, text))
                else:
                    rows.append((own, None, None, None, *_compared(last, digest, text, now)))
                part, own, last, digest = at, i, text, now
                if len(rows) >= 256 or len(text) > BATCH_BYTES:
                    yield told()
                    rows = []
        if part is not None:
            rows.append(ends(own, None, part, last))
        if rows:
            yield told()

    packed = keyed.mapInArrow(shrink, f"at int, doc_id {kind}, tie long, salt int, packed binary")
    id_type = to_arrow_type(packed.schema["doc_id"].dataType)
    dealt = packed.repartitionById(max(1, len(starts)), F.col("at")).sortWithinPartitions("at", F.col("doc_id").desc_nulls_last(), F.desc("tie"), F.desc("salt"))
    passed = settle(dealt.mapInArrow(run, f"doc_id {kind}, first int, last int, text string, {_FIELDS}"))
    # the range after each range: a number for each; then texts meet by it, two rows for each range
    around = Window.orderBy("at")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = passed.where("first is not null").select(F.col("first").alias("at")).select("at", F.coalesce(F.lead("at").over(around), F.first("at").over(whole)).alias("after"))
    firsts = passed.where("first is not null").select(F.col("first").alias("after"), F.col("text").alias("follower"))
    lasts = passed.where("last is not null").select(F.col("last").alias("at"), "doc_id", "text")
    pairs = lasts.join(after, "at").join(firsts.hint("shuffle_merge"), "after").select("doc_id", "text", "follower")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [_compared(t.as_py(), Digest.of(t.as_py()), f.as_py(), Digest.of(f.as_py())) for t, f in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", *_NAMES])

    out = passed.where("first is null and last is null").select("doc_id", *_NAMES).union(pairs.mapInArrow(close, f"doc_id {kind}, {_FIELDS}"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
