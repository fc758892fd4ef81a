import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from weftline.llm import simhash as S

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("a", T.LongType())])


def plain(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))


def least_reachable(items):
    """items: (id, fingerprint); the least id reachable over links of at most 3 bits, by brute force."""
    left, out = dict(enumerate(items)), {}
    while left:
        todo, seen = [left.popitem()[1]], []
        while todo:
            x = todo.pop()
            seen.append(x)
            near = [k for k, y in left.items() if (x[1] ^ y[1]).bit_count() <= 3]
            todo += [left.pop(k) for k in near]
        for i, _ in seen:
            out[i] = min(j for j, _ in seen)
    return out


def test_fingerprint_equals_plain():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50, 70_000]:
        text = " \t\v".join(rng.choice(["Ab", "É", "x y", "ab", "Zz"]) + str(rng.randrange(9)) for _ in range(n))
        assert S.fingerprint(text) == plain(text)
    assert S.fingerprint(None) == S.fingerprint(" \n\x0b") == 0
    assert S.fingerprint("ONE") == S.fingerprint(" one\r")


def clustered(seed, n):
    rng = random.Random(seed)
    out = []
    for c in range(n // 40 + 1):
        x = rng.getrandbits(64)
        for _ in range(40):
            out.append(x)
            for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 5])):
                x ^= 1 << rng.randrange(64)
    return out[:n]


def check(spark, fps, longest):
    df = spark.createDataFrame([(S._signed(x),) for x in set(fps)], "fp long").repartition(5)
    root = {r.node & (1 << 64) - 1: r.root for r in S.components(S.links(df, longest)).collect()}
    least = least_reachable([(S._signed(x), x) for x in set(fps)])
    assert {x: root.get(x, S._signed(x)) for x in set(fps)} == {x: least[S._signed(x)] for x in set(fps)}


def test_links_equal_brute_force(spark):
    check(spark, clustered(2, 600), S.LONGEST_LIST)


def test_long_lists_are_split_without_loss(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    ball = [centre] + [centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5]))) for _ in range(300)]
    check(spark, ball + clustered(4, 100), 20)


def test_match_keeps_lists_whole_across_batches():
    import pyarrow as pa

    fps = np.array([5, 4, 7, 3 << 40, 6], np.int64)
    mask, part = np.array([0, 0, 0, 1, 1], np.int64), np.array([9, 9, 9, 9, 9], np.int64)
    rows = [pa.RecordBatch.from_arrays([pa.array(mask[i : i + 1]), pa.array(part[i : i + 1]), pa.array(fps[i : i + 1])], ["mask", "part", "fp"]) for i in range(5)]
    got = {(a, b) for out in S._match(iter(rows)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert got == {(5, 4), (7, 4)}


def test_hard_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(3, "same words here again", "x", 1), (2, "same words here again", "y", 2), (2, "same words here again", "y", 2), (None, None, None, None), (9, "", "", 0), (8, " \n", "", 0), (7, long, "", 0), (6, long + " end", "", 0), (None, "alone in this world of text", "", 0)]
    got = sorted(map(tuple, S.near_duplicates(spark.createDataFrame(rows, KIND)).collect()), key=str)
    want_fp = [f"{plain(r[1]):016x}" for r in rows]
    assert sorted(x[1] for x in got) == sorted(want_fp)
    by = {(x[0], x[1]): x[2] for x in got}
    assert by[3, f"{plain(rows[0][1]):016x}"] == 2 and by[9, "0" * 16] == 8 and by[None, "0" * 16] == 8
    assert by[7, f"{plain(long):016x}"] == 6
    assert by[None, f"{plain(rows[-1][1]):016x}"] is None
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def test_query_equals_brute_force(spark, sf):
    from weftline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = least_reachable([(r.doc_id, plain(r.text)) for r in docs])
    got = QUERIES["op4_simhash_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {r.doc_id: (f"{plain(r.text):016x}", want[r.doc_id]) for r in docs}


def test_pairs_are_those_of_the_index_of_single_postings():
    """Counting postings one by one, over the whole inverted index, keeps the same pairs as counting in the lists."""
    from collections import Counter
    from itertools import combinations

    fps = np.unique(np.array([S._signed(x) for x in clustered(7, 400)], np.int64))
    index = {}
    for i, x in enumerate(fps.view(np.uint64).tolist()):
        for place in range(8):
            index.setdefault((place, x >> 8 * place & 255), []).append(i)
    counts = Counter(pair for listed in index.values() for pair in combinations(listed, 2))
    want = {pair for pair, n in counts.items() if n >= S.LEAST_BYTES}
    got = set()
    for mask in S._masks()[0]:
        part = fps & np.int64(S._signed(mask))
        order = np.argsort(part, kind="stable")
        keys = np.concatenate([[0], np.cumsum(part[order][1:] != part[order][:-1])])
        for x, y in S.counted(keys, fps[order]):
            got |= {(min(a, b), max(a, b)) for a, b in zip(order[x].tolist(), order[y].tolist(), strict=True)}
    assert got == want and len(want) > 100
    every = {(a, b) for a, b in combinations(range(len(fps)), 2) if ((int(fps[a]) ^ int(fps[b])) & ((1 << 64) - 1)).bit_count() <= S.MOST_BITS}
    assert every and every <= want, "no link is lost"


def test_hot_fingerprints_and_components(spark, monkeypatch):
    """A third of all rows of one text, joined by broadcast, comes out as by a shuffle."""
    from weftline.llm import shared

    rows = [(i, "the same few words again and again" if i % 3 == 0 else f"text number {i // 2} of its own kind", "x", 1) for i in range(120)] + [(None, None, "", 0), (500, "", "", 0)]
    df = spark.createDataFrame(rows, KIND)
    want = sorted(map(repr, S.near_duplicates(df).collect()))
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    assert sorted(map(repr, S.near_duplicates(df).collect())) == want


def test_dropping_with_clashing_names(spark):
    rows = [(i, f"some words for pair {i // 2} here", i, i, i, i) for i in range(20)] + [(None, "no id", 1, 1, 1, 1), (3, "again", 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _alone long, _shared long, id long, root long")
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {None, 3, *range(0, 20, 2)}


def similar(seed):
    """Sets of hashes: pairs at a Jaccard similarity of 0.8 to 0.9, large and small, and as many that are like none."""
    rng, out = np.random.default_rng(seed), []
    for n in [4, 9, 20, 60, 250, 900] * 12:
        common, own = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 64, n // 5, np.uint64)
        if n == 4:
            own = rng.integers(0, 1 << 64, 1, np.uint64)
            out += [np.sort(common), np.sort(np.append(common, own)), *rng.integers(0, 1 << 64, (2, 4), np.uint64)]
            continue
        half = len(own) // 2
        out += [np.unique(np.concatenate([common, x])) for x in (own[:half], own[half : 2 * half])]
        out += [rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2)]
    return out


def test_wide_equals_plain():
    for hashes in similar(1)[:20]:
        bits = np.unpackbits(np.frombuffer(S.wide(hashes), np.uint8))
        for word in (0, 1, S.LISTS // 4 - 1):
            seen = np.zeros(64, int)
            for h in hashes.tolist():
                m, top = (1 << 64) - 1, h + word * 0x9E3779B97F4A7C15
                x = top & m
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
                x = (x ^ x >> 27) * 0x94D049BB133111EB & m
                x ^= x >> 31
                seen += [x >> 8 * (k // 8) + 7 - k % 8 & 1 for k in range(64)]
            vote = S._VOTE[64 * word : 64 * word + 64]
            assert (bits[64 * word : 64 * word + 64] == ((seen + vote) * 2 > len(hashes) + 1)).all()


def test_all_pairs_at_the_least_similarity_meet(spark):
    """And who meets, meets as by all pairs of each list of the index."""
    from weftline.llm import jaccard as J

    sets = similar(2)
    rows = [(i, len(s), bytearray(S.wide(s)), bytearray(J.sketch(s))) for i, s in enumerate(sets)]
    got = S.meeting(spark.createDataFrame(rows, "fp long, size long, bits binary, sketch binary").repartition(3)).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.band, r.key), set()).add(r.fp)
    both = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    for a in range(0, len(sets), 4):
        assert 5 * len(np.intersect1d(sets[a], sets[a + 1])) >= 4 * len(np.union1d(sets[a], sets[a + 1]))
        assert (a, a + 1) in both
    bits = np.array([np.frombuffer(bytes(r[2]), np.uint8) for r in rows])
    entries = S.entries(np.arange(len(rows)), np.array([r[1] for r in rows]), bits, np.array([np.frombuffer(bytes(r[3]), np.uint8) for r in rows]))
    want = set()
    for a in range(len(rows)):
        rest = np.arange(a + 1, len(rows))
        near = rest[S.close(entries[np.full(len(rest), a)], entries[rest])]
        want |= {(a, int(b)) for b in near if (bits[a].reshape(-1, 2) == bits[b].reshape(-1, 2)).all(axis=1).any()}
    assert both == want
