import zlib

import pytest
from pyspark.sql import types as T

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_jaccard import kept  # noqa: E402
from tests.llm.test_packing import check  # noqa: E402
from weftline.llm import pii as P  # noqa: E402
from weftline.llm import toxicity as X  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxicity", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n_chars", T.LongType())])
ROWS = [(1, "one same text here", "a", "x", 18), (2, "one same text here", "b", "y", 18), (2, "one same text here", "b", "y", 18), (3, "write to a@b.co soon", "", "", 20), (3, "write to a@b.co soon", "", "", 20), (4, None, None, None, None), (5, "", "", "", 0), (None, "no id at all", None, None, 1), (None, "no id at all", None, None, 1), (None, "no id but another", "", "", 1), (6, "w " * 30_000, "", "", 60_000)]


def test_stages_take_hard_rows_and_keep_columns(spark, sf):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = corpus_pipeline.toxicity(spark, docs, sf)
    assert kept.schema.names == docs.schema.names and kept.count() == len(ROWS)
    once = corpus_pipeline.near_dedup(spark, docs, sf)
    assert once.schema.names == docs.schema.names
    assert sorted((str(r.doc_id), r.text) for r in once.collect() if r.text) == sorted([("1", ROWS[0][1]), ("3", ROWS[3][1]), ("None", "no id at all"), ("None", "no id but another"), ("6", ROWS[-1][1])])
    assert [r.doc_id for r in once.collect() if not r.text] == [4]
    clean = corpus_pipeline.pii(spark, docs, sf)
    assert clean.schema.names == docs.schema.names
    assert {(r.text, r.n_chars) for r in clean.collect() if r.doc_id == 3} == {("write to <email> soon", 21)}
    check([r[:2] for r in ROWS], corpus_pipeline.packing(spark, docs, sf).collect(), 2048)


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_run_equals_brute_force(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").collect()
    docs = {r.doc_id: r.text for r in read("documents")}
    known = sorted((r.doc_id, r.toxic) for r in read("labels") if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    scorer = X.Scorer(X.train([docs[i] for i, _ in known], [y for _, y in known]).folded())
    docs = {i: t for i, t in docs.items() if scorer.scores([t])[0] < X.THRESHOLD}
    docs = {i: P.redact(docs[i], P.find(docs[i], P.trained())) for i in kept(list(docs.items()))}
    check(list(docs.items()), corpus_pipeline.run(spark, sf).collect(), 2048)
