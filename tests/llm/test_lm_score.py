import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from weftline.llm import lm_score as L

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("g", T.StringType()), T.StructField("role", T.LongType())])


def brute(rows, target):
    """Losses by dictionaries: a text's own counts are taken out of its model."""
    seqs = [L.sequence(t) for _, t in rows]
    single, pair = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for (i, _), s in zip(rows, seqs, strict=True):
        single[i in target].update(s)
        pair[i in target].update(zip(s, s[1:]))
    vocabulary = len(single[True] | single[False])
    out = []
    for (i, _), s in zip(rows, seqs, strict=True):
        means = []
        for model in (True, False):
            own = (Counter(s), Counter(zip(s, s[1:]))) if (i in target) == model else (Counter(), Counter())
            total = sum(single[model].values()) - sum(own[0].values())
            means.append(sum(L.loss(pair[model][a, b] - own[1][a, b], single[model][a] - own[0][a], single[model][b] - own[0][b], total, vocabulary) for a, b in zip(s, s[1:])) / (len(s) - 1))
        out.append((str(i), i in target, len(s) - 1, *means))
    return sorted(out)


def same(got, want):
    got = sorted((str(r.doc_id), r.in_target, r.n_tokens, r.target_loss, r.background_loss) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3:] == pytest.approx(w[3:], abs=1e-9)


def made():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rng.choice(words[: 12 if i % 3 else 40]) for _ in range(rng.randint(1, 60))), "x", 1) for i in range(80)]


@pytest.mark.parametrize("group_bytes", [1 << 20, 600])
def test_equals_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(L, "PER_ROOT", 1)
    monkeypatch.setattr(L, "CHUNK_BYTES", 500)
    rows = made()
    target = {i for i, *_ in rows if i % 3}
    got = L.score_documents(spark.createDataFrame(rows, KIND), spark.createDataFrame([(i,) for i in target], "doc_id long"), group_bytes=group_bytes).collect()
    same(got, brute([r[:2] for r in rows], target))
    inside = [r.loss_difference for r in got if r.in_target]
    outside = [r.loss_difference for r in got if not r.in_target]
    assert sum(inside) / len(inside) < sum(outside) / len(outside)


@pytest.mark.parametrize("total", [0, 1, 10**8, 3 * 10**10, 10**14, 10**16])
def test_a_group_and_a_bucket_have_many_keys_in_common(total):
    groups = L.group_count(total)
    assert groups >= 1
    if groups > 1:
        assert total * 0.12 / groups**2 > 1000  # keys of a row: an n-gram for some 8 bytes of text


def test_groups_come_from_the_texts_not_from_the_plan(spark, monkeypatch):
    """A join and a UDF's output, whose sizes Spark can't tell, are scored as the rows themselves, and evaluated once."""
    from pyspark.sql import functions as F

    rows, seen = made(), spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(rows, KIND)
    joined = df.join(df.select(F.col("doc_id").alias("i")).crossJoin(spark.range(50)).groupBy("i").count(), F.col("doc_id") == F.col("i")).select(*df.columns).mapInArrow(told, df.schema)
    target = {i for i, *_ in rows if i % 3}
    counted = []
    monkeypatch.setattr(L, "group_count", lambda n, least, f=L.group_count: counted.append(n) or f(n, least))
    got = L.score_documents(joined, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    same(got, brute([r[:2] for r in rows], target))
    assert counted == [sum(len(r[1]) for r in rows)] and seen.value == len(rows)


def test_hard_rows(spark):
    rows = made()[:20] + [(100, None, None, None), (101, " \n", "", 0), (102, "tie tie", "", 0), (102, "tie tie", "", 0), (None, "no id", None, None), (103, "long " * 50_000, "", 0), (104, "<s> </s> É é", "", 0)]
    target = {1, 2, 102, 999}
    df = spark.createDataFrame(rows, KIND).repartition(3)
    same(L.score_documents(df, spark.createDataFrame([(1,), (2,), (2,), (102,), (999,), (None,)], "doc_id long")).collect(), brute([r[:2] for r in rows], target))


def test_empty_tables(spark):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    assert L.score_documents(spark.createDataFrame([], KIND), ids).collect() == []
    rows = made()[:5]
    same(L.score_documents(spark.createDataFrame(rows, KIND), ids.where("false")).collect(), brute([r[:2] for r in rows], set()))


def test_query(spark, sf):
    from weftline.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    same(QUERIES["op5_lm_scoring"](spark, sf).collect(), brute(docs, target))
