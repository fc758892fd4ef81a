import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import types as T
from tokenizers import Tokenizer

from weftline.llm import packing as P
from weftline.llm.bpe import default_path

LIBRARY = Tokenizer.from_file(default_path())
KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values()):
            rooms[k] -= lengths[i]
            go(i + 1, rooms)
            rooms[k] += lengths[i]
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def sequences(counts, capacity):
    """Pieces by sequence as the plan assigns them; checks that they are gapless."""
    rows, used = P.plan(counts, capacity)
    lengths = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    ranks = np.concatenate([np.arange(n) for n in counts.values()]).astype(np.int64)
    at, offset = P.assign(lengths, ranks, rows)
    found = defaultdict(list)
    for s, o, n in zip(at.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        found[s].append((o, n))
    for parts in found.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    assert sorted(found) == list(range(used))
    return used


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([10, 20, 31])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        left = {x: lengths.count(x) for x in set(lengths)}
        fixed = P.reduce_lengths(left, capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)
        assert all(sum(x) <= capacity for x, _ in fixed)
        assert sorted(rest + [x for xs, n in fixed for x in xs * n]) == sorted(lengths)


def test_plan_is_gapless_and_tight():
    rng = random.Random(2)
    for n in (1, 5, 60, 3000):
        counts = defaultdict(int)
        for _ in range(n):
            counts[min(2048, int(rng.expovariate(1 / 500)) + 1)] += rng.choice([1, 1, 7])
        used = sequences(dict(counts), 2048)
        least = -(-sum(k * v for k, v in counts.items()) // 2048)
        assert used <= least * 1.02 + 1
    assert sequences({1: 5000, 2048: 3, 700: 1000}, 2048) <= 3 + 500 + 1
    assert P.plan({}, 2048)[1] == 0


def test_plan_does_not_grow_with_documents():
    rng = np.random.default_rng(3)
    base = {int(k): int(n) for k, n in enumerate(rng.integers(0, 9, 2048), 1) if n}
    assert len(P.plan({k: n * 10_000 for k, n in base.items()})[0]) < 200_000


def check(rows, got, capacity):
    found = defaultdict(list)
    for r in got:
        found[r.sequence_id].append((r.offset, r.length))
    for parts in found.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    want = []
    for i, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= capacity else (len(ids) % capacity or capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)


def test_hard_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(9000))
    rows = [(1, long, "a"), (2, "", "b"), (3, None, None), (None, "no id", None), (4, "x <|endoftext|> y", ""), (5, "tie", ""), (5, "tie", ""), (6, " " * 3000 + "a", ""), (7, long, "")]
    got = P.pack_documents(spark.createDataFrame(rows, KIND), capacity=128).collect()
    check([r[:2] for r in rows], got, 128)


def test_white_space_that_the_fast_encoder_refuses():
    encode = P._encoder(open(default_path(), encoding="utf-8").read())
    text = " " * 2_000_000 + "a"
    assert encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], KIND)).collect() == []


def test_query(spark, sf):
    from weftline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op1_best_fit_packing"](spark, sf).collect()
    check(docs, got, 2048)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1
