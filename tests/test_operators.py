import hashlib
import json
import math
import random
import re
import unicodedata
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import student
from weftline.functions import text as T
from weftline.operators import align, control, corpus, fuse, langid, mask, metrics, order, router, stats, subword
from weftline.plans import provenance as P
from weftline.sources import corpus as S
from weftline.sources import downstream as D

HARD = ["ﬁ ½ Ａ", "é x", "a\x1cb\x1fc", "   x \n", "नमस्ते दुनिया", "😀 x", "", "   ", "plain text", "Ⅷ ™ ㎏"]


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_equals_python(spark):
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v)).strip() for v in HARD]
    assert one(spark, HARD, T.normalize) == want
    assert one(spark, [" x  y\x1c"], lambda c: T.normalize(c, collapse=False)) == ["x  y"]
    assert one(spark, [None], T.normalize) == [None]


def test_stable_split_equals_hashlib(spark):
    def plain(text):
        u = int.from_bytes(hashlib.sha256(f"7\0es\0{text}".encode()).digest()[:8], "big") / 2**64
        return "train" if u < 1.0 - 0.3 - 0.2 else "validation" if u < 1.0 - 0.3 - 0.2 + 0.3 else "test"

    texts = HARD + [f"doc {i}" for i in range(200)]
    assert one(spark, texts, lambda c: T.stable_split(c, F.lit("es"), 7, 0.3, 0.2)) == [plain(t) for t in texts]
    for bad in ((1.0, 0.0), (-0.1, 0.0), (0.6, 0.4)):
        with pytest.raises(ValueError):
            T.split_bounds(*bad)


def test_word_spans_and_ngrams(spark):
    texts = ["ab cde f", "", "é 漢字 😀x"]
    spans = one(spark, [t.split() for t in texts], T.word_spans, "array<string>")
    assert [[(s.start, s.end) for s in x] for x in spans] == [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    assert one(spark, texts, lambda c: T.char_ngrams(c, 2, 3)) == [[t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)] for t in texts]


def test_source_spans():
    for text in HARD + ["x½y"]:
        plain, spans = T.source_spans(text)
        assert plain == unicodedata.normalize("NFKC", text) and len(spans) == len(plain)
        assert all(0 <= a < b <= len(text) for a, b in spans)
        assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    assert T.source_spans("x½y")[1] == [(0, 1), (1, 2), (1, 2), (1, 2), (2, 3)]


def turns(streams):
    out, at = [], 0
    while any(len(s) > at for s in streams.values()):
        out += [(k, s[at]) for k, s in streams.items() if len(s) > at]
        at += 1
    return out


def test_interleave_and_budget_equal_a_plain_loop(spark):
    rng = random.Random(4)
    how = corpus.Preparation(languages=("en", "es", "de"), validation=0.1, test=0.1)
    rows = [(i, rng.choice(["en", "en", "es", "de", "xx"]), "w" * rng.randint(1, 40)) for i in range(150)]
    prepared = corpus.prepare(spark.createDataFrame(rows, "doc_id long, language string, text string").repartition(5), how)
    kept = {(r.doc_id, r.language): len(r.text) for r in prepared.where("split = 'train'").collect()}
    streams = {k: sorted(i for i, lang in kept if lang == k) for k in how.languages}
    got = corpus.prepared_stream(prepared, how, "doc_id", "train").orderBy("position").collect()
    assert [(r.language, r.doc_id) for r in got] == turns(streams) and [r.position for r in got] == list(range(len(got)))
    used, frozen, want = dict.fromkeys(streams, 0), set(), []
    for k, i in turns(streams):
        if k not in frozen:
            if used[k] + kept[i, k] > 300:
                frozen.add(k)
            else:
                used[k] += kept[i, k]
                want.append((k, i))
    budget = corpus.training_budget(prepared, how, 300, "doc_id").orderBy("position").collect()
    assert [(r.language, r.doc_id) for r in budget] == want
    assert corpus.training_budget(prepared, how, 0, "doc_id").count() == len(kept)
    with pytest.raises(ValueError):
        corpus.first_per_language(prepared, 10_000, "doc_id", strict=True)
    with pytest.raises(ValueError):
        order.resume(order.batches(corpus.prepared_stream(prepared, how, "doc_id"), 32), 99)


def test_metrics_equal_plain(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.randrange(5)) for _ in range(300)]
    got = metrics.classification_metrics(spark.createDataFrame(rows, "label int, prediction int")).first()
    f1 = []
    for c in {x for r in rows for x in r}:
        tp = sum(a == b == c for a, b in rows)
        n = sum(a == c for a, _ in rows) + sum(b == c for _, b in rows)
        f1.append(2 * tp / n)
    assert got.accuracy == pytest.approx(sum(a == b for a, b in rows) / 300) and got.macro_f1 == pytest.approx(sum(f1) / len(f1))
    assert metrics.classification_metrics(spark.createDataFrame([], "label int, prediction int")).collect() == []
    tokens = spark.createDataFrame([([1, -100, 2], [1, 1]), ([0], [0, 5])], "labels array<int>, predictions array<int>")
    assert [tuple(r) for r in metrics.token_pairs(tokens).collect()] == [(1, 1), (0, 0)]


def test_overlap_projection_and_transfer_equal_plain(spark):
    rng = random.Random(6)
    spans = lambda: [(a, a + rng.randint(1, 9)) for a in sorted(rng.sample(range(60), rng.randint(1, 9)))] + [(-1, -1)]
    docs = {d: (spans(), spans()) for d in range(12)}
    frame = lambda k, extra="": spark.createDataFrame([(d, i, a, b) for d, x in docs.items() for i, (a, b) in enumerate(x[k])], f"doc_id int, {'idx' if extra else 'pos'} int, start int, end int")
    want = {(d, i, j, min(b, e) - max(a, s)) for d, (x, y) in docs.items() for i, (a, b) in enumerate(x) for j, (s, e) in enumerate(y) if a >= 0 and s >= 0 and a < e and b > s}
    edges = align.overlaps(frame(0), frame(1), ["doc_id"], width=5)
    assert {tuple(r) for r in edges.select("doc_id", "l_pos", "r_pos", "weight").collect()} == want and edges.count() == len(want)
    vec = {(k, d, i): rng.random() for k in (0, 1) for d, x in docs.items() for i in range(len(x[k]))}
    vectors = [spark.createDataFrame([(d, i, [v]) for (k, d, i), v in vec.items() if k == side], "doc_id int, pos int, vector array<double>") for side in (0, 1)]
    for r in align.project(edges, vectors[0], vectors[1], ["doc_id"]).collect():
        met = [(w, vec[0, d, i]) for d, i, j, w in want if (d, j) == (r.doc_id, r.r_pos)]
        assert r.value == pytest.approx(sum(w * x for w, x in met) / sum(w for w, _ in met) if met else vec[1, r.doc_id, r.r_pos])
    words = frame(1, "idx").withColumn("label", F.col("idx") + 100)
    got = {(r.doc_id, r.pos): r.label for r in align.transfer_labels(frame(0), words, ["doc_id"]).collect()}
    for d, (tokens, ws) in docs.items():
        seen = set()
        for i, (a, b) in enumerate(tokens):
            hit = next((j for j, (s, e) in enumerate(ws) if s >= 0 and a >= 0 and a < e and b > s), None)
            assert got[d, i] == (-100 if hit is None or hit in seen else 100 + hit)
            seen.add(hit)


def test_masking_properties(spark):
    rows = [(d, p, 50 + p, p in (0, 9)) for d in range(40) for p in range(10)]
    tokens = spark.createDataFrame(rows, "doc_id int, pos int, token int, special boolean")
    got = mask.mask_tokens(tokens, ["doc_id"], 1, 0.05, 4, 500, special="special").collect()
    assert not any(r.masked for r in got if r.special)
    assert all(any(r.masked for r in got if r.doc_id == d) for d in range(40))
    assert all((r.label == r.token) == r.masked and (r.masked or r.input_id == r.token) for r in got)


def test_fusion_properties(spark):
    rows = [(0, c, p, [0.8, 0.1, 0.1], [0.5, 0.3, 0.2], c < 2) for c, p in enumerate([0.75, 0.25, 0.9])]
    df = spark.createDataFrame(rows, "doc_id int, candidate int, prior double, evidence array<double>, routing array<double>, ok boolean")
    weights = lambda **k: [r.weight for r in fuse.fusion_weights(df, ["doc_id"], "prior", "evidence", "routing", **k).orderBy("candidate").collect()]
    free, masked, off = weights(), weights(mask="ok"), weights(enabled=False)
    assert sum(free) == pytest.approx(1) and masked[2] == 0 and masked[0] == pytest.approx(0.75) and off == [1, 0, 0]
    assert free[2] > free[0] > free[1]
    shares = one(spark, [[0.01, 0.49, 0.5], [0.02, 0.03, 0.95]], lambda c: fuse.language_threshold(c, 0.05), "array<double>")
    assert shares[1] == [0, 0, 1] and shares[0] == pytest.approx([0, 0.49 / 0.99, 0.5 / 0.99])


def test_student_and_statistics(spark):
    assert student.t_cdf(2.7764451051977987, 4) == pytest.approx(0.975, abs=1e-12)
    assert student.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert student.t_cdf(1.0, 2) == pytest.approx(0.5 + 0.5 / math.sqrt(3), abs=1e-12)
    one_seed = stats.seed_summary(spark.createDataFrame([("a", 0.5)], "k string, score double"), ["k"]).first()
    assert (one_seed.n, one_seed.sd, one_seed.lower, one_seed.upper) == (1, 0, 0.5, 0.5)
    pairs = lambda rows: stats.paired_seed_test(spark.createDataFrame(rows, "k string, baseline double, proposed double"), ["k"]).first()
    assert math.isnan(pairs([("a", 0.1, 0.3)]).p) and math.isnan(pairs([("a", 0.5, 0.5)] * 3).p)
    up = pairs([("a", 0.25, 0.5)] * 3)
    assert up.t == math.inf and up.p == 0
    label, a, b = (np.random.default_rng(s).integers(0, 3, 50) for s in (1, 2, 3))
    got = stats.bootstrap_accuracy(label, a, b, 200, 9, 0.9)
    rng, plain = np.random.default_rng(9), []
    for _ in range(200):
        i = rng.choice(np.arange(50), 50, replace=True)
        plain.append((b[i] == label[i]).mean() - (a[i] == label[i]).mean())
    assert got["lower"] == pytest.approx(np.quantile(plain, 0.05)) and got["mean"] == pytest.approx(np.mean(plain))


def test_control(spark):
    rates = [r.factor for r in control.learning_rates(spark, 10, 4).orderBy("step").collect()]
    assert rates == pytest.approx([0.25, 0.5, 0.75, 1, 1, 5 / 6, 4 / 6, 3 / 6, 2 / 6, 1 / 6, 0])
    assert control.finetune_warmup(25, 0.1) == 2 and control.pretrain_warmup(25, 0.1) == 2
    losses = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate([3, 2, 2, 2.5, 1])], "run string, step int, loss double")
    got = control.early_stopping(losses, 2, ["run"]).orderBy("step").collect()
    assert [(r.improved, r.waited, r.stop) for r in got] == [(True, 0, False), (True, 0, False), (False, 1, False), (False, 2, True)]


def segmentations(word, known):
    if not word:
        return [(0.0, [])]
    return [(known[word[:n]] + s, [word[:n], *rest]) for n in range(1, len(word) + 1) if word[:n] in known for s, rest in segmentations(word[n:], known)]


def test_k_best_equals_brute_force():
    rng = random.Random(8)
    known = {"".join(p): -float(rng.randint(1, 64)) / 8 for n in (1, 2, 3) for p in product("ab", repeat=n) if n == 1 or rng.random() < 0.7}
    lattice = subword.Lattice([*((s, 0.0) for s in subword.SPECIALS), *known.items()])
    for word in {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)}:
        every = sorted((s for s, _ in segmentations(word, known)), reverse=True)[:5]
        got = lattice.best(word, 5)
        assert [s for s, _ in got] == pytest.approx(every)
        assert all("".join(word[a:b] for _, a, b in path) == word for _, path in got)
    assert lattice.best("axb", 3) == [(-60.0, [(lattice.ids["a"], 0, 1), (3, 1, 2), (lattice.ids["b"], 2, 3)])]
    both = lattice.candidates("ab ba", 4)
    want = sorted((a + b for a, _ in segmentations("ab", known) for b, _ in segmentations("ba", known)), reverse=True)[:4]
    assert [s for s, _ in both] == pytest.approx(want) and lattice.candidates("", 3) == [(0.0, [])]


def test_merges_fit_and_encode(spark):
    counts = [("low", 5), ("lower", 2), ("newest", 6), (" widest", 3), ("été", 2)]
    merges = subword.fit_merges(counts, 280)
    assert merges.pieces[:5] == list(subword.SPECIALS)
    first = next(iter(merges.ranks))
    pairs = {}
    for w, n in counts:
        s = merges.spell(w)
        for p in zip(s, s[1:]):
            pairs[p] = pairs.get(p, 0) + n
    assert pairs[first] == max(pairs.values())
    for w in ["lowest", "été", "x y", "漢", ""]:
        parts = merges.encode_word(w)
        assert "".join(merges.pieces[i] for i, _, _ in parts) == "".join(merges.spell(w))
        greedy = merges.spell(w)
        while True:
            ranked = [(merges.ranks[p], i) for i, p in enumerate(zip(greedy, greedy[1:])) if p in merges.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            greedy[i : i + 2] = ["".join(greedy[i : i + 2])]
        assert [merges.pieces[i] for i, _, _ in parts] == greedy


def test_lattice_fit_is_deterministic_and_likely(spark):
    text = [(" ".join(random.Random(i).choices(["the", "then", "other", "anthem", "tea"], k=30)),) for i in range(20)]
    counts = subword.word_counts(spark.createDataFrame(text, "text string"))
    a, b = (subword.fit_lattice(counts, 24, longest=6, rounds=1) for _ in range(2))
    assert a.pieces == b.pieces and len(a.pieces) <= 24 and "the" in a.known
    assert all(a.best(w, 1)[0][0] > -60 for w in ("the", "anthem", "tea"))


def test_language_prior(tmp_path, spark):
    rows = [(0, 1, "en", "the president spoke"), (1, 1, "es", "el presidente hablo"), (2, 1, "hi", "राष्ट्रपति ने कहा")]
    df = spark.createDataFrame(rows, "position int, nth int, language string, text string")
    prior = langid.fit_language_prior(df, ("en", "es", "hi"), shortest=2, longest=3, buckets=256)
    shares = prior.shares("El presidente habló")
    assert len(shares) == 3 and sum(shares) == pytest.approx(1) and max(shares) == shares[1]
    prior.save(str(tmp_path / "p.npz"))
    assert langid.LanguagePrior.load(str(tmp_path / "p.npz")).shares("x y") == prior.shares("x y")
    told = langid.predict_language(df.select("text"), prior).collect()
    assert all(r.shares == pytest.approx(prior.shares(r.text)) for r in told)
    with pytest.raises(ValueError):
        langid.fit_language_prior(df, ("en", "fr"))


def test_router_ignores_padding():
    rng = np.random.default_rng(3)
    head = router.Router(np.ones(6), np.zeros(6), rng.normal(size=(6, 5)), np.zeros(5), rng.normal(size=(5, 3)), np.zeros(3))
    tokens, on = rng.normal(size=(2, 4, 6)), np.array([[1, 1, 0, 0], [1, 1, 1, 1]])
    other = tokens.copy()
    other[0, 2:] = 99
    assert np.allclose(head.shares(tokens, on), head.shares(other, on)) and np.allclose(head.shares(tokens, on).sum(axis=1), 1)


def test_corpus_folders(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([(i, "en", f"text {i}") for i in range(25)], "source_order long, language string, text string")
    about = S.write_language(rows, f"{root}/en", rows_per_shard=10)
    assert about["parts"] == ["part-000000.parquet", "part-000001.parquet", "part-000002.parquet"]
    assert S.validate_shards(spark, f"{root}/en") == {"rows": 25, "parts": 3, "disk_bytes": sum(p.stat().st_size for p in (tmp_path / "en").glob("*.parquet")), "text_bytes": about["actual_text_bytes"]}
    assert [r.text for r in S.read_corpus(spark, root, ("en",)).orderBy("source_order").collect()] == [f"text {i}" for i in range(25)]
    assert S.after(S.read_corpus(spark, root, ("en",)), 7).count() == 18
    with pytest.raises(Exception, match="another language"):
        S.read_language(spark, f"{root}/en", "es").collect()
    with pytest.raises(FileExistsError):
        S.write_language(rows, f"{root}/en")
    S.write_language(rows.withColumn("language", F.lit("es")).limit(3), f"{root}/es")
    assert set(S.validate_sources(spark, root, ("en", "es"), 1000)) == {"en", "es"}
    with pytest.raises(ValueError, match="apart"):
        S.validate_sources(spark, root, ("en", "es"), 10)
    good = (tmp_path / "en/metadata.json").read_text()
    (tmp_path / "en/metadata.json").write_text(json.dumps(json.loads(good) | {"rows": 26}))
    (tmp_path / "en/.metadata.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        S.validate_shards(spark, f"{root}/en")
    (tmp_path / "en/metadata.json").write_text(good)
    spark.createDataFrame([("en", 1)], "language string, more int").coalesce(1).write.parquet(f"{root}/odd")
    next((tmp_path / "odd").glob("*.parquet")).rename(tmp_path / "en/part-000002.parquet")
    (tmp_path / "en/.part-000002.parquet.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="columns"):
        S.validate_shards(spark, f"{root}/en")


def test_downstream(spark, tmp_path):
    raw = spark.createDataFrame([(["a", "b"], ["O", "B"], "train"), (["c"], ["O"], "test")], "hindi_words array<string>, labels array<string>, split string")
    rows = D.canonical(raw, "org/x_NER_EN_HI")
    assert rows.columns == ["split", "tokens", "ner_tags", "text", "task", "language_pair"] and {r.text for r in rows.collect()} == {"a b", "c"}
    place = f"file://{tmp_path}/d"
    assert D.save(rows, place) == {"train": 1, "test": 1} and D.load(spark, place).count() == 2
    assert D.save(rows, place) == {"train": 1, "test": 1} == D.validate(spark, place)
    (tmp_path / "d/split=dev").mkdir()
    with pytest.raises(ValueError, match="dev"):
        D.validate(spark, place)
    assert D.limited(rows.withColumn("i", F.lit(1)), 1, "i").count() == 2
    with pytest.raises(ValueError):
        D.task_of("org/none")
    (tmp_path / "e").mkdir()
    (tmp_path / "e/other").write_text("x")
    with pytest.raises(FileExistsError):
        D.save(rows, f"file://{tmp_path}/e")


def test_provenance(tmp_path):
    assert P.config_identity({"b": "é", "a": [1, 2]}) == hashlib.sha256('{"a":[1,2],"b":"é"}'.encode()).hexdigest()
    assert P.stable_hash({"b": 1, "a": tmp_path}) == hashlib.sha256(json.dumps({"a": str(tmp_path), "b": 1}).encode()).hexdigest()
    calls = []
    manifest = P.Manifest(tmp_path / "m.json")
    work = lambda: calls.append(1) or {"n": len(calls)}
    assert manifest.run("s", "x", work) == manifest.run("s", "x", work) == {"n": 1}
    assert P.Manifest(tmp_path / "m.json").run("s", "y", work) == {"n": 2}
    assert not manifest.reusable("s", "x", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        manifest.run("bad", "x", lambda: 1 / 0)
    assert P.read_json(tmp_path / "m.json")["stages"]["bad"]["status"] == "failed"
    config = {"languages": ["en"], "splits": {"train": 0.9, "validation": 0.067, "test": 0.033}, "filtering": {"min_characters": 1, "max_characters": 9}}
    plan = P.build_plan("fit", config, {"en": {"signature": "s", "parts": ["p"], "text_bytes": 5}})
    assert P.write_or_reuse_plan(tmp_path / "p.json", plan) == plan == P.write_or_reuse_plan(tmp_path / "p.json", P.build_plan("fit", config, plan["sources"]) | {"created_at_utc": plan["created_at_utc"]})
    assert P.validate_plan(plan, lambda k: "s") and plan["total_text_bytes"] == 5
    for broken in (lambda: P.validate_plan(plan, lambda k: "t"), lambda: P.write_or_reuse_plan(tmp_path / "p.json", P.build_plan("other", config, {})), lambda: P.validate_plan(plan | {"purpose": "x"}, lambda k: "s")):
        with pytest.raises(ValueError):
            broken()
    (tmp_path / "v.json").write_text("{}")
    arm = lambda name, **training: P.register_arm(tmp_path / "e.json", name, tmp_path / "p.json", {"layers": 2}, {"seed": 1, **training}, tmp_path / "v.json")
    first = arm("a", candidate_preparation_workers=3)
    assert arm("b", candidate_preparation_workers=9, candidate_prefetch_batches=1)["arms"]["a"]["vocabulary_sha256"] == P.file_hash(tmp_path / "v.json")
    base = hashlib.sha256(json.dumps({"model": {"layers": 2}, "training": {"seed": 1}}, sort_keys=True).encode()).hexdigest()
    want = {"corpus": P.file_hash(tmp_path / "p.json"), "base_training": base, "seed": 1}
    assert first["shared"] == want and first["comparison_id"] == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest()[:16]
    for other in ({"seed": 2}, {"dataloader_workers": 4}):
        with pytest.raises(ValueError):
            arm("c", **other)
    P.record_result(tmp_path / "e.json", "a", {"score": 1})
    assert P.read_json(tmp_path / "e.json")["arms"]["a"]["result"] == {"score": 1}
    P.write_json(tmp_path / "old.json", {"manifest_version": 7})
    with pytest.raises(ValueError):
        P.Manifest(tmp_path / "old.json")
    P.check_weights({"en": 1, "es": 1.0})
    fine = {"special_tokens": list(subword.SPECIALS), "vocab_size": 100}
    P.validate_tokenizer(fine)
    P.validate_prior({"max_examples_per_language": 1, "ngram_range": [2, 5], "n_features": 8})
    P.validate_finetuning({"seeds": [1, 2], "epochs": 1, "batch_size": 2})
    for bad in (
        lambda: P.check_weights({"en": 2}), lambda: P.validate_tokenizer(fine | {"vocab_size": 5}), lambda: P.validate_tokenizer(fine | {"special_tokens": ["<pad>"]}),
        lambda: P.validate_prior({"n_features": 8}), lambda: P.validate_prior({"max_examples_per_language": 1, "ngram_range": [5, 2], "n_features": 8}), lambda: P.validate_finetuning({"seeds": [1, 1], "epochs": 1, "batch_size": 2}),
    ):
        with pytest.raises(ValueError):
            bad()
    assert P.experiment_record({"plan": tmp_path / "p.json", "none": tmp_path / "q"})["missing"] == ["none"]
    assert P.with_defaults({"a": {"x": 1}}, {"a": {"x": 0, "y": 2}, "b": 3}) == {"a": {"x": 1, "y": 2}, "b": 3}
    (tmp_path / "art").mkdir()
    assert not P.destination_ready(tmp_path / "art", {"f"})
    box = P.CheckpointFolder(tmp_path / "ck", ["f"])
    box.publish(lambda d: (d / "f").write_text("1"))
    with pytest.raises(FileNotFoundError):
        box.publish(lambda d: None)
    assert box.complete() and (tmp_path / "ck/f").read_text() == "1"
    (tmp_path / "ck").rename(tmp_path / "ck.previous")
    assert box.restore(lambda d: (d / "f").read_text()) == "1"
    with pytest.raises(FileNotFoundError):
        P.CheckpointFolder(tmp_path / "nothing", ["f"]).restore(lambda d: None)
