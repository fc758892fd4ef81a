"""Alignment and masking within rows, encoders, and plans."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import align, mask, metrics, stats, subword
from weftline.plans import contract

SPAN = "array<struct<start:int,end:int>>"


def tiled(rng, n):
    """Spans in order that may touch, leave gaps, or be none."""
    out, at = [], 0
    for _ in range(n):
        a = at + rng.choice([0, 0, 0, 1, 3])
        b = a + rng.randint(1, 6)
        out.append(rng.choice([(a, b)] * 6 + [(-1, -1), (a, a)]))
        at = b
    return out


def any_spans(rng, n):
    return [(a, a + rng.randint(-1, 9)) for a in (rng.randint(-1, 30) for _ in range(n))]


def plain_edges(left, right):
    return [(i, j, min(b, d) - max(a, c)) for i, (a, b) in enumerate(left) for j, (c, d) in enumerate(right) if a >= 0 and c >= 0 and b > a and d > c and a < d and b > c]


def plain_labels(tokens, words, labels):
    given, out = set(), []
    for a, b in tokens:
        met = [j for j, (c, d) in enumerate(words) if a >= 0 and b > a and c >= 0 and d > c and a < d and b > c]
        if met and met[0] not in given:
            given.add(met[0])
            out.append(labels[met[0]])
        else:
            out.append(-100)
    return out


def made(seed=1, n=60):
    rng = random.Random(seed)
    make = lambda k: rng.choice([tiled, tiled, any_spans])(rng, k)
    return [(i, make(rng.randint(0, 20)), make(rng.randint(0, 14))) for i in range(n)]


def test_edges_and_labels_equal_all_pairs(spark):
    rows = made()
    labels = {i: [random.Random(i + j).randint(0, 9) for j in range(len(w))] for i, _, w in rows}
    df = spark.createDataFrame([(i, t, w, labels[i], [x % 2 == 0 for x in range(len(w))]) for i, t, w in rows], f"i int, t {SPAN}, w {SPAN}, labels array<int>, keep array<boolean>").repartition(3)
    got = df.select("i", align.overlap_edges("t", "w").alias("e"), align.labels_of("t", "w", "labels").alias("l"), align.first_overlaps("t", "w", "keep", F.transform("labels", lambda x: x.cast("double"))).alias("f")).collect()
    for r in got:
        _, t, w = rows[r.i]
        edges = plain_edges(t, w)
        assert [tuple(x) for x in r.e] == edges
        assert r.l == plain_labels(t, w, labels[r.i])
        firsts = [min((j for a, j, _ in edges if a == i and j % 2 == 0), default=-1) for i in range(len(t))]
        assert [tuple(x) for x in r.f] == [(j, None if j < 0 else labels[r.i][j]) for j in firsts]


def test_projection_equals_the_definition(spark):
    table = np.random.default_rng(3).normal(size=(11, 5))
    rows = made(7, 30)
    pick = lambda n, k: [(k * 3 + p * 5) % 11 for p in range(n)]
    df = spark.createDataFrame([(i, t, pick(len(t), i), w, pick(len(w), i + 1)) for i, t, w in rows], f"i int, t {SPAN}, ti array<int>, w {SPAN}, wi array<int>")
    got = {r.i: r.vectors for r in align.project_rows(df, table, "i", "t", "ti", "w", "wi").collect()}
    pooled = {r.i: r.vectors for r in align.project_rows(df, table, "i", "t", "ti", "w", "wi", pooled=True).collect()}
    for i, t, w in rows:
        edges, ti, wi = plain_edges(t, w), pick(len(t), i), pick(len(w), i + 1)
        want = []
        for j in range(len(w)):
            mine = [(a, n) for a, b, n in edges if b == j]
            want.append(sum(n * table[ti[a]] for a, n in mine) / sum(n for _, n in mine) if mine else table[wi[j]])
        assert np.allclose(np.array(got[i]).reshape(-1, 5), np.array(want).reshape(-1, 5))
        assert np.allclose(pooled[i], np.mean(want, axis=0) if want else np.zeros(5))


def test_vector_table_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, v array<double>")
    assert align.vector_table(df, "k", "v").tolist() == [[3.0, 4.0], [1.0, 2.0]]
    monkeypatch.setattr(align, "MOST_TABLE_BYTES", 10)
    with pytest.raises(ValueError):
        align.vector_table(df, "k", "v")


def test_masking_of_lists_equals_masking_of_tokens(spark):
    rows = [(i, [(i * 7 + k) % 50 for k in range(i % 9)], [k % 4 == 0 for k in range(i % 9)]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, ids array<int>, special array<boolean>")
    how = {"seed": 5, "share": 0.2, "mask_id": 4, "vocabulary": 60}
    tokens = df.select("doc_id", F.posexplode(F.arrays_zip("ids", "special")).alias("pos", "x")).select("doc_id", "pos", F.col("x.ids").alias("token"), "x.special")
    want = {(r.doc_id, r.pos): (r.masked, r.decision, r.input_id, r.label) for r in mask.mask_tokens(tokens, ["doc_id"], special="special", **how).collect()}
    lists = mask.mask_lists(df, "ids", "doc_id", special="special", **how)
    got = {(r.doc_id, k): tuple(x) for r in lists.collect() for k, x in enumerate(r.masking)}
    assert got == want
    whole = {}
    for (i, k), x in got.items():
        whole.setdefault(i, []).append(x[0] and not rows[i][2][k])
        assert not (x[0] and rows[i][2][k])
    assert all(any(v) for i, v in whole.items() if not all(rows[i][2]))


def test_candidates_show_nothing_that_is_hidden(spark):
    df = spark.createDataFrame([(1, [7, 8, 9], [(0, 0.1), (-1, None), (2, 0.85)])], "doc_id int, ids array<int>, met array<struct<place:int,value:double>>")
    r = df.select(mask.mask_candidates(F.col("ids"), F.col("met"), F.col("doc_id"), F.lit(1), 5, 4, 60).alias("x")).first().x
    assert (r[0].input_id, r[0].label) == (4, 7) and (r[1].input_id, r[1].label) == (8, -100) and r[2].label == 9 and 0 <= r[2].input_id < 60


def test_padding(spark):
    df = spark.createDataFrame([(0, [5, 6, 7], [1, -100, 2], [(0, 1), (1, 2), (2, 3)]), (0, [8], [3], [(0, 2)]), (1, [], [], [])], f"batch int, ids array<int>, l array<int>, s {SPAN}")
    got = mask.pad(df, "batch", "ids", labels="l", spans="s").orderBy("batch", F.size("l").desc(), "ids").collect()
    short = next(r for r in got if r.ids == [8])
    assert (short.input_ids, short.attention_mask, short.labels, [tuple(x) for x in short.spans]) == ([8, 1, 1], [1, 0, 0], [3, -100, -100], [(0, 2), (-1, -1), (-1, -1)])
    assert next(r for r in got if r.batch == 1).input_ids == []


def test_viterbi_equals_the_library():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    rng = random.Random(2)
    pieces = [*((s, 0.0) for s in subword.SPECIALS), *((x, -round(rng.uniform(1, 9), 3)) for x in sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(60)} - {"c"}))]
    lattice, library = subword.Lattice(pieces), Tokenizer(Unigram(pieces, unk_id=3))
    for _ in range(800):
        word = "".join(rng.choice("abcdxé") for _ in range(rng.randint(1, 14)))
        assert [t for t, _, _ in lattice.viterbi(word)] == library.encode(word, add_special_tokens=False).ids, word


def test_merges_equal_the_librarys_trainer():
    """The same vocabulary, in the same order, as the library learns from the same words."""
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice(["an", "er", "th", "on", "é", "ü", "x"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ",", "."]) for _ in range(30)) for _ in range(60)]
    library = Tokenizer(models.BPE(unk_token="<unk>"))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=420, min_frequency=2, special_tokens=list(subword.SPECIALS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    import regex

    counts = {}
    for t in texts:
        for part in regex.findall(subword.PARTS, t):
            counts[part] = counts.get(part, 0) + 1
    ours = subword.fit_merges(counts.items(), 420)
    assert set(ours.pieces) == set(library.get_vocab())
    for t in texts[:20]:
        want = library.encode(t, add_special_tokens=False)
        got = [p for m in regex.finditer(subword.PARTS, t) for p in [(ours.pieces[i], m.start() + a, m.start() + b) for i, a, b in ours.encode_word(m.group())]]
        assert [p for p, _, _ in got] == want.tokens


def test_merging_few_places_equals_merging_many(monkeypatch):
    rng = random.Random(6)
    counts = [("".join(rng.choice("aab") for _ in range(rng.randint(1, 12))), rng.randint(1, 9)) for _ in range(300)]
    counts = list(dict(counts).items())
    fits = []
    for few in (0, 5, 10**9):
        monkeypatch.setattr(subword, "FEW", few)
        made = subword.fit_merges(counts, 400)
        fits.append((made.pieces, made.ranks))
    assert fits[0] == fits[1] == fits[2] and len(fits[0][1]) > 50


def test_parts_equal_the_pattern(spark):
    import regex

    texts = ["don't stop, it's 12,5 % «né»", "", "a  b", "漢字 x_1", "we'll go"]
    got = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(subword.parts_of(F.col("t")).alias("p")).collect()]
    assert got == [regex.findall(subword.PARTS, t) for t in texts]


def toy():
    return subword.fit_merges([("the", 9), (" the", 8), (" then", 5), (",", 4)], 300)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "the then, the"), (2, ""), (3, None)], "doc_id int, text string")
    merges = toy()
    got = {r.doc_id: [tuple(x) for x in r.tokens] for r in subword.encode_texts(df, merges).collect()}
    assert [merges.pieces[i] for i, _, _ in got[1]] == ["the", "Ġthen", ",", "Ġthe"] and [x[1:] for x in got[1]] == [(0, 3), (3, 8), (8, 9), (9, 13)] and got[2] == got[3] == []
    assert {r.doc_id: len(r.input_ids) for r in subword.sequences(df, merges, 4).collect()} == {1: 4}
    rows = spark.createDataFrame([(1, ["the", "then", "x"], [4, 5, 6])], "i int, words array<string>, labels array<int>")
    r = subword.task_examples(rows, merges, "words", "labels", 16).first()
    assert r.token_labels == [-100, 4, 5, 6, -100] or r.token_labels[0] == r.token_labels[-1] == -100 and [x for x in r.token_labels if x >= 0] == [4, 5, 6]
    assert len(r.input_ids) == len(r.spans) == len(r.token_labels) and r.input_ids[0] == 0 and r.input_ids[-1] == 2


def test_chunks_and_shifted_candidates(spark):
    lattice = subword.Lattice([*((s, 0.0) for s in subword.SPECIALS), *((c, -4.0) for c in "thean"), ("the", -1.0)])
    df = spark.createDataFrame([(1, "  the then the"), (2, "the")], "doc_id int, text string")
    cut = subword.chunked(df, lattice, 4)
    assert {(r.doc_id, r.chunk_start, r.text) for r in cut.collect()} == {(1, 2, "the the"), (2, 0, "the")}
    paths = subword.candidate_paths(cut, lattice, subword.Policy(most=1)).join(cut.select("doc_id", "chunk_start"), "doc_id")
    first = next(r for r in subword.shifted(paths).collect() if r.doc_id == 1)
    assert first.starts == [-1, 2, 6, -1] and first.ends == [-1, 5, 9, -1]
    with pytest.raises(Exception, match="without pieces"):
        subword.chunked(spark.createDataFrame([(1, " ")], "doc_id int, text string"), lattice, 4).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_normalized_once(spark, sf):
    for name in ("corpus_normalize", "corpus_length_filter", "corpus_split_summary"):
        assert plan_of(contract.QUERIES[name](spark, sf)).count("ArrowEvalPython") == 1, name


@pytest.mark.parametrize("name", ["alignment_edges", "token_label_transfer", "mlm_mask", "candidate_mask_propagation", "alignment_projection"])
def test_tokens_do_not_leave_their_row(spark, sf, name):
    """No exchange but that which deals the texts of few files over the cores."""
    plan = plan_of(contract.QUERIES[name](spark, sf))
    assert plan.count("Exchange") <= 1 and "SortMergeJoin" not in plan and "Window" not in plan


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "c", "d"])], ["t"])
    assert [len(x) for x in T.slices(batch, 0, most_bytes=12)] == [2, 1, 2]
    assert [len(x) for x in T.slices(batch, 0, most_rows=1)] == [1] * 5


def test_seed_summaries_of_many_scores(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(500)] + [("b", 1.0)], "g string, score double")
    got = {r.g: r for r in stats.seed_summary(df, ["g"]).collect()}
    assert got["a"].n == 500 and got["a"].lower < got["a"].mean < got["a"].upper and got["b"].lower == got["b"].upper == 1.0


def test_losses_and_lookups(spark):
    batches = spark.createDataFrame([("en", 0, 1.0, 0.5, 0.6), ("en", 1, 3.0, 0.1, 0.4), ("es", 0, 4.0, 0.2, 0.2)], "language string, batch int, mlm double, routing double, weight double")
    got = {r.language: tuple(r)[1:] for r in metrics.fused_evaluation(batches, ["language"], "mlm", "routing", "weight", 0.5).collect()}
    assert got["en"] == pytest.approx((2.0, 0.3, 0.5, 2.15)) and got["es"] == pytest.approx((4.0, 0.2, 0.2, 4.1))
    losses = metrics.mean_of_batch_means(batches, "mlm", "batch", ["language"])
    assert tuple(metrics.macro_loss(losses).first()) == (3.0, 2)
    ids = spark.createDataFrame([(1, [0, 0, 2]), (2, [])], "d int, ids array<int>")
    table = spark.createDataFrame([(0, [1.0, 2.0]), (2, [10.0, 20.0])], "k int, v array<double>")
    assert {(r.dim, r.total, r.tokens) for r in metrics.looked_up(ids, "ids", table, "k", "v", ["d"]).collect()} == {(0, 12.0, 3), (1, 24.0, 3)}
