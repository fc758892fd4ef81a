import random

import corpus_pipeline
from weftline.llm import jaccard as J


def plain(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def kept(rows):
    """Ids that stay by brute force over all pairs."""
    sets, least = {i: plain(t) for i, t in rows}, {i: i for i, _ in rows}
    moved = True
    while moved:
        moved = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x == y or 5 * len(x & y) >= 4 * len(x | y):
                    low = min(least[a], least[b])
                    moved |= least[a] != low or least[b] != low
                    least[a] = least[b] = low
    return sorted(i for i, low in least.items() if i == low)


def edited():
    rng, rows = random.Random(7), []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 500]))]
        rows.append(" ".join(words))
        for changes in (1, 2, 4, 8):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "other"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_pipeline_drops_edited_copies(spark, sf):
    rows = edited()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_pipeline_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == kept([(r.doc_id, r.text) for r in docs.collect()])


def test_sets():
    assert len(J.shingles(None)) == len(J.shingles(" \n")) == 0 and J.text_key("") == 0
    assert J.text_key("One  two\n") == J.text_key("one two") != J.text_key("one three")
    assert len(J.shingles("a b c d e a b c d e")) == 5


def test_pairs_of_large_groups(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:i], "other", *words[i + 1 :]])) for i in range(0, 400, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edges = J.links(docs, J._marked(docs, "doc_id", "text"), "doc_id", "text")
    root = {r.node: r.root for r in J.components(edges).collect()}
    assert len(root) == 199 and len(set(root.values())) == 1
    assert edges.count() < 199 * 100 / 2


def test_sketches_never_rule_out_a_near_copy():
    rng = random.Random(5)
    seen = [0, 0]
    for n in (1, 2, 9, 40, 300, 3000):
        for share in (0.0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = [w if rng.random() > share / 5 else "x" + w for w in words]
            a, b = J.shingles(" ".join(words)), J.shingles(" ".join(other))
            x, y = (J.np.frombuffer(J.sketch(s), J.np.uint64)[None] for s in (a, b))
            both = len(J.np.intersect1d(a, b))
            apart = len(a) + len(b) - 2 * both
            assert int(J.np.bitwise_count(x ^ y).sum()) <= apart
            near = 5 * both >= 4 * (len(a) + len(b) - both)
            told = bool(J.may_be_near(x, y, J.np.array([len(a) + len(b)]))[0])
            assert told or not near
            seen[0] += near
            seen[1] += not told
    assert min(seen) > 5


def test_a_large_group_makes_few_pairs(spark):
    """Copies of one text, each with words of its own: some near each other, some only near the original, some to none."""
    rng, base = random.Random(9), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 6, 9])):
            words[rng.randrange(120)] = f"own{i}x{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in J.drop_near_copies(docs).collect()) == kept(rows)


def test_pipeline_finds_copies_by_simhash_alone(spark, sf, monkeypatch):
    """What doesn't meet in the index of positional bytes isn't found: there is no other way beside it."""
    docs, asked = spark.createDataFrame(edited(), "doc_id long, text string"), []

    def none(classes):
        asked.append(set(classes.columns))
        return classes.selectExpr("0 as band", "fp as key", "fp").where("false")

    monkeypatch.setattr(J, "meeting", none)
    assert corpus_pipeline.near_dedup(spark, docs, sf).count() == len({J.text_key(t) for _, t in edited()})
    assert asked and {"fp", "bits"} <= asked[0]
