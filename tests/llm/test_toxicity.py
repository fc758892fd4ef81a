import random
import zlib

import numpy as np
from pyspark.sql import types as T

from weftline.llm import toxicity as X

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxic", T.StringType()), T.StructField("score", T.DoubleType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def made(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "in", "re", "st", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for _ in range(n):
        words, toxic = [word() for _ in range(rng.randint(3, 80))], rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zugwumf", "kibblax", "quorvid"]) + rng.choice(["", "er", "on", "ing"]))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_learns_and_generalises():
    rows = made(500, 1)
    model = X.train([t for t, _ in rows], [y for _, y in rows])
    scorer = X.Scorer(model.folded())
    fresh = made(300, 2)
    right = (scorer.scores([t for t, _ in fresh]) >= X.THRESHOLD) == np.array([y == 1 for _, y in fresh])
    assert right.mean() > 0.97
    low, seen, misspelt = scorer.scores(["an er thon in re", "an er zugwumf in re", "an er zugwumff in re"])
    assert low < 0.3 < misspelt and seen >= X.THRESHOLD
    assert scorer.scores(["an er " * 9000 + "zugwumf"])[0] >= X.THRESHOLD, "long texts don't thin it out"


def test_scorer_equals_plain_forward_pass():
    rows = made(60, 3)
    model = X.train([t for t, _ in rows], [y for _, y in rows], rounds=5)
    texts = [rows[0][0], "", "same same same", "one, (two) «drei»!", " ".join(str(i) for i in range(30))]
    want = []
    for text in texts:
        words, best = X.tokens(text) or [""], -np.inf
        for i in range(0, len(words), X.BAG):
            vector = np.zeros(X.WIDTH)
            for w in set(words[i : i + X.BAG]):
                buckets, _ = X.features([w])
                vector += model.embeddings[buckets].astype(float).mean(axis=0) / X.BAG
            logits = model.weights @ vector + model.biases
            best = max(best, np.exp(logits[1]) / np.exp(logits).sum())
        want.append(best)
    assert np.allclose(X.Scorer(model.folded()).scores(texts), want, atol=1e-6)


def plain_score(model, text):
    """The worst bag's softmax, bag by bag: the average of the embeddings of its places."""
    words, best = X.tokens(text or "") or [""], -np.inf
    for i in range(0, len(words), X.BAG):
        vector = np.zeros(X.WIDTH)
        for w in set(words[i : i + X.BAG]):
            buckets, _ = X.features([w])
            vector += model.embeddings[buckets].astype(float).mean(axis=0) / X.BAG
        logits = model.weights @ vector + model.biases
        best = max(best, 1 / (1 + np.exp(logits[0] - logits[1])))
    return best


def plain_train(texts, labels, rounds, rate=0.05, spread=8.0, seed=11):
    """Gradient steps by loops over texts, bags, words and n-grams."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (X.BUCKETS, X.WIDTH)).astype(np.float32)
    w = np.array([-1, 1], np.float32)[:, None] * rng.normal(0, 0.5, X.WIDTH).astype(np.float32)
    b = np.array([X.START, -X.START], np.float32)
    parted = [X.tokens(t) or [""] for t in texts]
    grams = {x: X.features([x])[0].tolist() for t in parted for x in t}
    seen = np.zeros(X.BUCKETS)
    for x in grams:
        for g in grams[x]:
            seen[g] += sum(x in t for t in parted)
    common = seen >= X.LEAST_TEXTS
    e[~common] = 0
    bags = [[sorted(set(t[i : i + X.BAG])) for i in range(0, len(t), X.BAG)] for t in parted]
    share = {y: 0.5 / labels.count(y) for y in (0, 1)}
    moments = [(np.zeros_like(x), 0.0) for x in (e, w, b)]
    for step in range(1, rounds + 1):
        slopes = [np.zeros(x.shape) for x in (e, w, b)]
        for text, y in zip(bags, labels, strict=True):
            vectors = [sum(e[grams[x]].mean(axis=0) for x in bag) / X.BAG for bag in text]
            p = [1 / (1 + np.exp(-((w[1] - w[0]) @ v + b[1] - b[0]))) for v in vectors]
            whole = 1 - np.prod([1 - x for x in p])
            for bag, v, x in zip(text, vectors, p, strict=True):
                g = (-(1 - whole) / whole if y else 1) * share[y] * x
                for word in bag:
                    for gram in grams[word]:
                        if common[gram]:
                            slopes[0][gram] += g / X.BAG / len(grams[word]) * (w[1] - w[0])
                slopes[1] += np.stack([-g * v, g * v])
                slopes[2] += [-g, g]
        slower = min(1.0, 2 * (1 - (step - 1) / rounds))
        for k, x in enumerate((e, w, b)):
            first, second = moments[k]
            first, second = 0.9 * first + 0.1 * slopes[k], 0.9 * second + 0.1 * (slopes[k] ** 2).sum()
            moments[k] = first, second
            x -= slower * (rate if k else spread) * (first / (1 - 0.9**step)) / ((second / (1 - 0.9**step)) ** 0.5 + 1e-12)
    e[~common] = 0
    return X.Model(e, w, b)


def test_training_equals_plain_loops():
    rows = made(40, 8)
    texts, labels = [t for t, _ in rows], [y for _, y in rows]
    got, want = X.train(texts, labels, rounds=6), plain_train(texts, labels, 6)
    assert np.allclose(got.embeddings, want.embeddings, atol=2e-3) and np.allclose(got.weights, want.weights, atol=2e-3) and np.allclose(got.biases, want.biases, atol=2e-3)


def test_the_sample_is_bounded_in_documents_and_bytes(spark):
    rows = [(i, f"text {i} " + "x" * (i % 7), "", 0.0) for i in range(90)]
    labels = [(i, 1, i % 2) for i in range(90)]
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    some, fewer = (X.sample(df, marks, 10, n).collect() for n in (1 << 20, 60))
    kinds = [r.toxic for r in some]
    assert kinds.count(0) == kinds.count(1) == 10 and set(fewer) < set(some)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in some) and sum(len(r.text) for r in fewer) <= 120


def test_features_of_words_do_not_depend_on_neighbours():
    words = ["idiot", "x", "", "wörter.", "—", "a" * 300]
    buckets, counts = X.features(words)
    parts = np.split(buckets, np.cumsum(counts)[:-1])
    for w, part in zip(words, parts, strict=True):
        assert sorted(part) == sorted(X.features([w])[0])


def test_one_kind_of_label_or_none():
    for labels, high in (([], False), ([0, 0], False), ([1], True)):
        score = X.Scorer(X.train(["a b"] * len(labels), labels).folded()).scores(["", "a"])
        assert ((score >= X.THRESHOLD) == high).all()


def test_hard_rows(spark):
    rows = [(i, t, "x", 1.0) for i, (t, _) in enumerate(made(200, 4))] + [(900, None, None, None), (901, "", "", 0.0), (None, "no id", "", 0.0), (902, "tie", "", 0.0), (902, "tie", "", 0.0), (903, "an er " * 40_000, "", 0.0)]
    labels = [(i, 1, y) for i, (_, y) in enumerate(made(200, 4))] + [(None, 1, 1), (900, None, None), (3, 0, 0), (5000, 1, 1)]
    got = X.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(str(r[0]) for r in rows) == sorted(str(r.doc_id) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1


def test_held_out_labels_are_not_used(spark):
    rows = made(120, 5)
    docs = spark.createDataFrame([(i, t, "", 0.0) for i, (t, _) in enumerate(rows)], DOCS)
    labels = [(i, 1, y) for i, (_, y) in enumerate(rows)]
    other = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in labels]
    a, b = (sorted(map(tuple, X.toxicity(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, other))
    assert a == b


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert X.toxicity(spark.createDataFrame([], DOCS), none).collect() == []
    assert [r.predicted for r in X.toxicity(spark.createDataFrame([(1, "a", "", 0.0)], DOCS), none).collect()] == [0]


def test_query(spark, sf):
    from weftline.llm.queries import QUERIES

    got = QUERIES["op2_toxicity"](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    learn = sorted(i for i in docs if i in marks and zlib.crc32(str(i).encode()) % 3 != 1)
    model = X.train([docs[i] for i in learn], [marks[i] for i in learn])
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        want = plain_score(model, docs[i])
        assert abs(r.score - want) < 1e-4 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
    held = [(rows[i].predicted, y) for i, y in marks.items() if i in rows and rows[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.8 and not any(p > y for p, y in held)
