import zlib

from pyspark.sql import types as T

from weftline.llm.sharding import shard_by_bytes

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("size", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("range_id", T.LongType())])


def brute(rows, shards):
    """rows (id, text): cut in order of id, null first, size and checksum."""
    told = sorted(((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    total, before, slots, out = sum(r[1] for r in told), 0, {}, []
    for (known, i), size, crc in told:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i if known else None, size, crc, shard, slots[shard]))
        before += size
    return sorted(out, key=str)


def same(df, rows, shards):
    assert sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str) == brute(rows, shards)


def test_hard_rows(spark):
    rows = [(i, "é" * (i * 37 % 90)) for i in range(200)] + [(None, None), (None, "x"), (300, "big" * 20_000), (301, ""), (5, "again"), (5, "again"), (302, None)]
    df = spark.createDataFrame([(i, t, "s", 9, 9) for i, t in rows], KIND).repartition(7)
    for shards in (1, 4, 40):
        same(shard_by_bytes(df, shards), rows, shards)


def test_few_rows_and_none(spark):
    same(shard_by_bytes(spark.createDataFrame([(1, "only", "", 0, 0)], KIND), 40), [(1, "only")], 40)
    assert shard_by_bytes(spark.createDataFrame([], KIND)).collect() == []


def test_shards_are_near_equal(spark, sf):
    from weftline.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op3_sharding"](spark, sf)
    same(got, docs, 40)
    sizes = {}
    for r in got.collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    largest = max(len(t.encode()) + 16 for _, t in docs)
    assert all(abs(s - sum(sizes.values()) / 40) <= largest for s in sizes.values())
