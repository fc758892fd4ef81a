import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from weftline.llm import digest as D

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("at", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(2, 8))) for _ in range(n))


def plain_counts(data):
    counts, mask = [0] * D.BUCKETS, 0xFFFFFFFF
    for salt, (i, j, k) in enumerate(D.TRIPLETS):
        for at in range(len(data) - k):
            h = (data[at + i] * 0x9E3779B1 & mask) ^ (data[at + j] * 0x85EBCA77 & mask) ^ (data[at + k] * 0xC2B2AE3D & mask) ^ (salt * 0x27D4EB2F & mask)
            h = h * 0x165667B1 & mask
            h = (h ^ h >> 15) * 0x2C1B3C6D & mask
            counts[h >> 22] += 1
    return counts


def test_counts_equal_plain_also_across_chunks(monkeypatch):
    data = prose(1, 60).encode()
    want = plain_counts(data)
    assert D.bucket_counts(np.frombuffer(data, np.uint8)).tolist() == want
    monkeypatch.setattr(D, "_CHUNK", 7)
    assert D.bucket_counts(np.frombuffer(data, np.uint8)).tolist() == want


def test_digest_round_trip_and_bounds():
    texts = ["", "a", "ab", "abcde", prose(2, 5), prose(3, 3000)]
    for t in texts:
        a = D.Digest.of(t)
        assert str(D.Digest.parse(str(a))) == str(a) and len(str(a)) == 2 + D.BUCKETS // 2
        assert D.likeness(a, a) == 1
        for u in texts:
            b = D.Digest.of(u)
            assert 0 <= D.likeness(a, b) == D.likeness(b, a) <= 1


def test_likeness_falls_with_edits():
    words = prose(4, 1500).split()
    other = prose(5, 1500).split()
    near = [D.likeness(D.Digest.of(" ".join(words)), D.Digest.of(" ".join(words[: 1500 - k] + other[:k]))) for k in (0, 50, 300, 1000, 1500)]
    assert near == sorted(near, reverse=True) and near[2] > 0.7 and near[4] < near[2] - 0.2


def brute(rows):
    """rows in order: what each must come to."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, follower = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        a, b, c = D.Digest.of(text), D.Digest.of(edited), D.Digest.of(follower)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), D.likeness(a, b), D.likeness(a, c)))
    return sorted(out, key=str)


def in_order(rows):
    """Descending ids, none last; equal ids by the checksum of their texts, the largest first."""
    tie = lambda t: int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64))
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))


def test_ties_of_different_texts_and_a_hot_id(spark):
    rows = [(7 if i % 3 == 0 else i, prose(i % 50, 1 + i % 9), "x", 1) for i in range(150)] + [(None, prose(i, 4), "", 0) for i in range(40)]
    want = brute(in_order(rows))
    for n in (1, 4, 9):
        got = D.compare_with_next(spark.createDataFrame(rows, KIND).repartition(n)).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_a_hot_id_is_dealt_over_ranges(spark):
    rows = [(7, "always the same text", "x", 1)] * 400 + [(i, prose(i, 3), "x", 1) for i in range(100)]
    df = spark.createDataFrame(rows, KIND).repartition(8)
    keyed = df.select("doc_id", D.F.xxhash64("text").alias("tie"), D.F.spark_partition_id().alias("salt"), "text")
    assert len(D._ranges(keyed, 8)) > 4


def test_hard_rows(spark):
    rows = [(i, prose(i, i % 40), "x", 1) for i in range(60)] + [(100, None, None, None), (101, "", "", 0), (7, prose(7, 7), "x", 1), (None, "no id", "", 0), (102, prose(9, 20_000), "", 0)]
    order = in_order(rows)
    got = D.compare_with_next(spark.createDataFrame(rows, KIND).repartition(6)).collect()
    assert sorted(map(tuple, got), key=str) == brute(order)


def test_one_row_and_none(spark):
    one = D.compare_with_next(spark.createDataFrame([(5, "all alone", "", 0)], KIND)).collect()
    assert [tuple(r) for r in one] == brute([(5, "all alone")]) and one[0].near_next == 1
    assert D.compare_with_next(spark.createDataFrame([], KIND)).collect() == []


def test_query(spark, sf):
    from weftline.llm.queries import QUERIES

    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = QUERIES["op7_document_fingerprints"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)
