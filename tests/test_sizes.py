"""What a step holds at once doesn't follow its input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import align, fuse, stats, subword
from weftline.plans import contract


def test_spans_of_characters_come_in_slices():
    told = list(T.nfkc_spans.func(iter([pa.array(["a" * 1000] * 5000 + [None, "x½y"])])))
    assert max(len(x) for x in told) <= 512 and sum(len(x) for x in told) == 5002
    assert told[-1].to_pylist()[-2:] == [None, [{"start": a, "end": b} for a, b in T.source_spans("x½y")[1]]]


def test_slices_are_weighed_by_their_texts_and_lists():
    assert T.weights(pa.array(["ab", None, "é"])).tolist() == [2, 0, 2]
    assert T.weights(pa.array([["ab", "c"], None, [], ["d"]])).tolist() == [19, 0, 0, 9]
    assert T.weights(pa.array([[1, 2], [3]]).slice(1)).tolist() == [8]
    assert list(T.runs(T.weights(pa.array(["abc", "d", "efgh"])), 4)) == [(0, 2), (2, 1)]


def test_alignment_is_worked_out_in_slices():
    spans = pa.array([[{"start": k, "end": k + 1} for k in range(3000)]] * 200, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    flags, values, labels = (pa.array([[x] * 3000] * 200) for x in (True, 0.5, 7))
    for told in (align.overlap_edges.func(iter([(spans, spans)])), align.labels_of.func(iter([(spans, spans, labels)])), align.first_overlaps.func(iter([(spans, spans, flags, values)]))):
        parts = list(told)
        assert sum(map(len, parts)) == 200 and max(map(len, parts)) < 100
        assert {len(x) for part in parts for x in part} == {3000}


def test_words_are_segmented_once_for_all_texts(monkeypatch):
    seen, lattice, cache = [], subword.Lattice([*((s, 0.0) for s in subword.SPECIALS), ("a", -1.0), ("b", -2.0), ("ab", -2.5)]), {}
    best = subword.Lattice.best
    monkeypatch.setattr(subword.Lattice, "best", lambda self, word, k: seen.append(word) or best(self, word, k))
    first, second = (lattice.candidates(t, 3, cache=cache) for t in ("ab ba ab", "ba ab"))
    assert seen == ["ab", "ba"]
    assert len(first) == 3 and [s for s, _ in second] == [-5.5, -6.0]


def test_pieces_are_cut_from_texts_in_one_go():
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    texts, tokens = pa.array(["añb c", "", None, "é"]), pa.array([[(7, 0, 2), (8, 2, 3), (9, 4, 5)], [], [], [(3, 0, 1)]], kind)
    assert [x for part in subword.spelled.func(iter([(texts, tokens)])) for x in part.to_pylist()] == ["añ b c", "", None, "é"]


def test_vectors_are_opened_after_they_have_come_together(spark, sf):
    for name in ("fused_vectors", "embedding_lookup"):
        plan = contract.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode") == 1 and plan.index("posexplode") < plan.index("Aggregate"), name


def test_sums_of_weighted_vectors(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, [1.0, 2.0]), (1, 1, 2.0, [3.0, 0.0]), (2, 0, 1.0, [7.0, 8.0])], "d int, candidate int, weight double, v array<float>")
    assert sorted(map(tuple, fuse.fused_arrays(rows, ["d"], "v").collect())) == [(1, 0, 6.5), (1, 1, 1.0), (2, 0, 7.0), (2, 1, 8.0)]


def test_report_lines_are_printed_as_sql_prints_them(spark):
    import duckdb

    row = ("q", 0.03125, 0.00005, 1.0, 0.5, 0.25, 0.28125, 0.12345, 1.23e-09)
    names = ["task", *(f"{c}_{x}" for c in ("baseline", "proposed") for x in ("mean", "lower", "upper")), "mean_difference", "p"]
    got = stats.report_lines(spark.createDataFrame([row], names), ["task"]).first().line
    want = duckdb.execute("SELECT printf('| q | %.4f [%.4f, %.4f] | %.4f [%.4f, %.4f] | %+.4f | %.4g |', ?, ?, ?, ?, ?, ?, ?, ?)", list(row[1:])).fetchone()[0]
    assert got == want and got.endswith("| 1.23e-09 |")


def test_merges_are_fitted_away_from_the_driver(spark):
    counts = [("ab", 1 << 30), (" ab", 3), ("xyxy", 5), (" été", 4), ("a" * 9, 2)]
    here, apart = subword.fit_merges(counts, 300), subword.fit_merges_apart(spark.createDataFrame(counts, "word string, n long"), 300)
    assert (here.pieces, here.ranks) == (apart.pieces, apart.ranks)
    assert next(iter(here.ranks)) == ("a", "b") and ("x", "y") in here.ranks and ("xy", "xy") in here.ranks


def test_vocabularies_are_fitted_on_all_training_records(monkeypatch, spark):
    rows = spark.createDataFrame([(1, "en", "aa ab", "train"), (2, "en", "aa", "test"), (3, "es", "aa", "train")], "doc_id long, language string, text string, split string")
    monkeypatch.setattr(contract, "_prepared", lambda *_: rows)
    monkeypatch.setattr(contract.corpus, "training_budget", lambda *_: rows.limit(0))
    assert {r.word: r.n for r in contract._training_counts(spark, "")[1].collect()} == {"aa": 2, " ab": 1}
    assert "aa" in {r.piece for r in contract.bpe_vocab(spark, "").collect()}


def test_expectations_of_many_words_equal_those_of_each():
    lattice = subword.Lattice([("a", -1.0), ("b", -2.0), ("ab", -1.5), ("ba", -3.0), ("aba", -2.0), ("é", -4.0)])
    words, counts = ["abab", "é", "axb", "", "baab", "a"], [3, 1, 5, 2, 1, 7]
    want = {}
    for w, n in zip(words, counts, strict=True):
        for p, x in subword._expected(w, lattice)[1].items():
            want[p] = want.get(p, 0) + n * x
    names = [p for p, _ in lattice.pieces]
    got = subword._expected_of(words, np.array(counts, float), subword.Arcs(names, np.array([x for _, x in lattice.pieces])))
    assert dict(zip(names, got, strict=True)) == pytest.approx({p: want.get(p, 0.0) for p in names})


def test_disordered_tokens_are_those_of_the_table(spark):
    lists = [([-1, 0, 2, 1, -1], [-1, 2, 4, 3, -1]), ([5, 5], [5, 6]), ([], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(lists)], "i int, a array<int>, b array<int>")
    tokens = spark.createDataFrame([(i, k, *x) for i, (a, b) in enumerate(lists) for k, x in enumerate(zip(a, b, strict=True))], "i int, pos int, start int, end int")
    want = {r.i: r.n for r in align.spans_in_order(tokens, ["i"]).groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert {r.i: r.n for r in df.select("i", align.disordered("a", "b").alias("n")).collect()} == {i: want.get(i, 0) for i in range(3)} == {0: 1, 1: 1, 2: 0}
