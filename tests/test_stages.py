"""Vocabulary artifacts, stages, analysis, control and inference."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import control, router, stats, subword
from weftline.plans import analysis, stages
from weftline.sources import corpus, vocabulary
from weftline.streaming import ingest


def test_vocabularies_are_kept_and_read_by_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    merges = subword.fit_merges([("the", 9), (" then", 5), (" été", 4)], 290)
    lattice = subword.Lattice([*((s, 0.0) for s in subword.SPECIALS), ("a", -2.0), ("ab", -2.5), ("b", -3.0)])
    for name, made in (("m", merges), ("l", lattice)):
        place = f"file://{tmp_path}/{name}"
        about = vocabulary.save(spark, place, made, "id-1")
        assert vocabulary.save(spark, place, made, "id-1") == about and about["vocab_size"] == len(made.pieces)
        assert vocabulary.load(spark, place, "id-1").pieces == made.pieces
        library = Tokenizer.from_file(str(tmp_path / name / "tokenizer.json"))
        for text in ("the then été x", "ab ba abab", ""):
            rows = spark.createDataFrame([(text,)], "text string")
            ids = [t.id for t in subword.encode_texts(rows, vocabulary.load(spark, place)).first().tokens]
            assert ids == library.encode(text, add_special_tokens=False).ids
        with pytest.raises(ValueError):
            vocabulary.load(spark, place, "id-2")
        with pytest.raises(ValueError):
            vocabulary.load(spark, place, kind="other")
    (tmp_path / "l/tokenizer.json").unlink()
    with pytest.raises(FileNotFoundError):
        vocabulary.load(spark, f"file://{tmp_path}/l")
    with pytest.raises(FileExistsError):
        vocabulary.save(spark, f"file://{tmp_path}/l", lattice, "id-1")


SETTINGS = {"languages": ["en", "es"], "splits": {"train": 0.9, "validation": 0.067, "test": 0.033}, "filtering": {"min_characters": 1, "max_characters": 99}, "tolerance": 500, "downstream": ["org/x_NER_EN_HI"]}


def test_preparation_by_mode(spark, tmp_path):
    raw = f"file://{tmp_path}/raw"
    for k in SETTINGS["languages"]:
        rows = spark.createDataFrame([(i, k, f"text {i}") for i in range(12)], "source_order long, language string, text string")
        corpus.write_language(rows, f"{raw}/{k}", rows_per_shard=5)
    spark.createDataFrame([(["a", "b"], ["O", "B"], "train"), (["c"], ["O"], "test")], "hindi_words array<string>, labels array<string>, split string").write.parquet(f"{raw}/org__x_NER_EN_HI")
    box = stages.Preparation(spark, raw, f"file://{tmp_path}/done", tmp_path / "record", SETTINGS)
    with pytest.raises(FileNotFoundError):
        box.run("evaluate", tasks=True)
    assert not (tmp_path / "record").exists()
    with pytest.raises(ValueError):
        box.run("other")
    first = box.run("train", tasks=True)
    assert first["downstream"] == {"org/x_NER_EN_HI": {"train": 1, "test": 1}} and set(first["plans"]) == set(stages.PURPOSES)
    noted = json.loads((tmp_path / "record/manifest.json").read_text())
    assert {s["status"] for s in noted["stages"].values()} == {"completed"} and len(noted["stages"]) == 4
    assert len(list((tmp_path / "record").glob("config_*.yaml"))) == 1 and json.loads((tmp_path / "record/dataset_info.json").read_text())["downstream_split_rows"]
    again = box.run("resume", tasks=True)
    assert again["plans"] == first["plans"] and box.run("evaluate", tasks=True)["downstream"] == first["downstream"]
    assert stages.load_settings(next((tmp_path / "record").glob("config_*.yaml")), ("languages",)) == SETTINGS
    with pytest.raises(ValueError):
        stages.load_settings(next((tmp_path / "record").glob("config_*.yaml")), ("training",))
    (tmp_path / "raw/en/part-000001.parquet").unlink()
    with pytest.raises(FileNotFoundError):
        box.run("evaluate")


def tree(labels=(0, 1, 1, 0), other=None, seeds=(1, 2)):
    arm = lambda said, score, mine: {"metrics": {"accuracy": score, "labeled_tokens": 4.0, **({"f1": score} if mine else {})}, "predictions": list(said), "labels": list(labels)}
    out = {"org/a": {"task": "ner", "seeds": {str(s): {"merges": arm((0, 1, 0, 0), 0.75, True), "candidates": arm((0, 1, 1, 0), 1.0 - s / 100, False)} for s in seeds}}}
    if other:
        out["org/a"]["seeds"]["1"]["candidates"]["labels"] = list(other)
    return out


def test_analysis_of_a_result_tree(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(tree(), indent=1))
    found = analysis.results(spark, f"file://{tmp_path}/r.json")
    report, bootstrap = analysis.analyze(found, [1, 2], "merges", "candidates", samples=200)
    r = report.collect()
    assert [(x.repository, x.metric, x.n) for x in r] == [("org/a", "accuracy", 2)] and r[0].mean_difference == pytest.approx(0.235)
    want = stats.bootstrap_accuracy(np.array([0, 1, 1, 0]), np.array([0, 1, 0, 0]), np.array([0, 1, 1, 0]), 200, 1, 0.95)
    got = bootstrap.first().asDict()
    assert {k: got[k] for k in want} == pytest.approx(want)
    with pytest.raises(ValueError, match="differ"):
        analysis.analyze(found, [1, 2, 3], "merges", "candidates")
    with pytest.raises(ValueError, match="differ"):
        analysis.analyze(found, [1], "merges", "candidates")
    (tmp_path / "bad.json").write_text(json.dumps(tree(other=(0, 1, 1, 1))))
    bad = analysis.results(spark, f"file://{tmp_path}/bad.json")
    with pytest.raises(Exception, match="labels differ"):
        analysis.paired_predictions(bad, 1, "merges", "candidates").collect()


def test_bootstrap_of_any_metric():
    rng = np.random.default_rng(0)
    label, a, b = (rng.integers(0, 3, 40) for _ in range(3))
    accuracy = lambda y, p: float((y == p).mean())
    assert stats.bootstrap_metric(label, a, b, accuracy, 50, 3, 0.9) == pytest.approx(stats.bootstrap_accuracy(label, a, b, 50, 3, 0.9))


def test_run_matrix_scalars_and_order(spark, tmp_path):
    repositories = spark.createDataFrame([("a",)], "repository string")
    done = spark.createDataFrame([("a", 1, "x")], "repository string, seed int, arm string")
    assert control.run_matrix(repositories, [1, 2], ["x"], done).count() == 1
    assert control.run_matrix(repositories, [1], ["x"], done, evaluate_only=True).count() == 0
    with pytest.raises(ValueError):
        control.run_matrix(repositories, [1, 2], ["x"], done, evaluate_only=True)
    for step in (1, 2):
        control.log_scalars(spark.createDataFrame([("r", "loss", step, 0.5)], "run string, tag string, step int, value double"), f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2
    seen, waits = [], iter([True, False])
    assert control.run_in_order([("a", lambda: None), ("b", lambda: None)], lambda: next(waits), 0, seen.append) == ["a", "b"]
    assert [x["status"] for x in seen] == ["waiting", "running", "running", "completed"]
    with pytest.raises(ZeroDivisionError):
        control.run_in_order([("a", lambda: 1 / 0), ("b", lambda: None)], note=seen.append)
    assert seen[-1]["status"] == "stopped" and seen[-1]["stage"] == "a"


def test_heads_and_inference(spark):
    rng = np.random.default_rng(1)
    head = router.TaskHead(rng.normal(size=(4, 3)), np.zeros(3), rng.normal(size=(3, 2)), np.ones(2))
    assert router.parameter_count(head) == 12 + 3 + 6 + 2
    x = rng.normal(size=(5, 4))
    assert np.allclose(head.logits(x)[2], np.tanh(x[2] @ head.first) @ head.second + 1)
    with pytest.raises(ValueError):
        head.logits(rng.normal(size=(5, 3)))
    routing = router.Router(np.ones(4), np.zeros(4), rng.normal(size=(4, 5)), np.zeros(5), rng.normal(size=(5, 3)), np.zeros(3))
    with pytest.raises(ValueError):
        routing.shares(rng.normal(size=(2, 3, 4)), np.ones((2, 4)))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(5)], "i int, v array<double>")

    def make():
        return lambda batch: head.classes(np.array(batch.column(1).to_pylist())).tolist()

    got = {r.i: r.prediction for r in router.infer(rows, make, "long", batch_rows=2).collect()}
    assert got == dict(enumerate(head.classes(x).tolist()))
    with pytest.raises(Exception, match="predictions for"):
        router.infer(rows, lambda: lambda batch: [1], "long").collect()


def plain_take(rows, limit):
    """One language after another: up to the first record that passes the limit."""
    used, out, frozen = {}, [], set()
    for i, k, t in sorted(rows):
        size = len((t or "").encode())
        if k in frozen or not size:
            continue
        if used.get(k, 0) + size > limit:
            frozen.add(k)
            continue
        used[k] = used.get(k, 0) + size
        out.append((i, k, t, used[k]))
    return sorted(out)


def test_ingest_goes_on_and_replaces_what_a_failure_left(spark, tmp_path):
    rows = [(i, "en" if i % 3 else "es", None if i % 11 == 0 else "é" * (i * 7 % 13)) for i in range(60)]
    base, kind = f"file://{tmp_path}", "i long, language string, text string"
    schema = spark.createDataFrame([], kind).schema
    for part in (rows[:25], rows[25:40], rows[40:]):
        spark.createDataFrame(part, kind).repartition(2).write.mode("append").parquet(f"{base}/in")
        ingest.ingest(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck", 150, "i", files_per_batch=100)
    got = spark.read.parquet(f"{base}/out/kept")
    assert sorted((r.i, r.language, r.text, r.running) for r in got.collect()) == plain_take(rows, 150)
    state = {r.language: r for r in ingest.progress(spark, f"{base}/out").collect()}
    assert all(r.used <= 150 for r in state.values()) and any(r.frozen for r in state.values())
    # a batch that is run again from the state before it keeps the same
    batch = spark.createDataFrame(rows[25:40], kind)
    before = spark.read.parquet(f"{base}/out/state").where("batch = 0").drop("batch")
    kept, after = ingest.take(batch, before, 150, "i")
    assert {(r.i, r.running) for r in kept.collect()} == {(r.i, r.running) for r in got.where(F.col("batch") == 1).collect()}
    assert {tuple(r) for r in after.select("language", "used", "consumed", "frozen").collect()} == {tuple(r) for r in spark.read.parquet(f"{base}/out/state").where("batch = 1").select("language", "used", "consumed", "frozen").collect()}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from weftline import storage

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())
