import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
import regex
from pyspark.sql import types as T
from tokenizers import Tokenizer

from weftline.llm import bpe as B

SOURCE = open(B.default_path(), encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SOURCE)
MODEL = B.Model(SOURCE)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts():
    rng = random.Random(5)
    pool = ["the", " of", "é", "ß", "\n\n", "  ", "\t", "123", "don't", "I'LL", "<|endoftext|>", "<|endof", "नमस्ते", "漢字", "😀", " ", " ", "'s", "_", "...", "a" * 40, "é", "\x1c"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", " " * 5000 + "x", "ab" * 30_000, "z" * 7000, "é" * 9000, "՘ new letter", "<|endoftext|>"]


def test_patterns_are_the_same():
    assert B.WORDS == public_tokenizers.PATTERN


def test_splitter_equals_the_pattern():
    split = B.word_splitter()
    for c in [*range(0x300), *range(0x1E00, 0x2100), 0x3000, 0x660, 0x2160]:
        for s in (f"a{chr(c)}1{chr(c)}! {chr(c)} a_b ' 's{chr(c)}{chr(c)}", f"{chr(c)} {chr(c)}"):
            assert split(s) == regex.findall(B.WORDS, s), hex(c)
    for t in texts():
        assert split(t) == regex.findall(B.WORDS, t)


def test_tables_differ_only_where_unassigned():
    words = regex.compile(B.WORDS)
    for c in [*range(0x0, 0xD800, 7), *range(0xE000, 0x110000, 997), 0x558, 0x88F, 0x107BB]:
        s = f"a{chr(c)}1{chr(c)}! {chr(c)} a"
        if [b - a for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(s)] != [len(w) for w in words.findall(s)]:
            assert unicodedata.category(chr(c)) == "Cn"


@pytest.mark.parametrize("lexicon", [False, True])
def test_encoder_equals_library(lexicon):
    words = [w.encode() for t in texts()[:150] for w in regex.findall(B.WORDS, t) if len(w.encode()) <= B.SHORT_WORD]
    lex = B.Lexicon.compile(sorted(set(words)), MODEL) if lexicon else None
    encoder = B.Encoder(MODEL, lex, SOURCE)
    ids, counts = encoder.encode(texts())
    at = 0
    for t, n in zip(texts(), counts, strict=True):
        assert ids[at : at + n].tolist() == ids_of(t), t[:80]
        at += n


def test_lexicon_shares_suffixes_and_maps(tmp_path):
    words = [b"walking", b"talking", b"stalking", b"walked", b"talked", b"", b"a"]
    lex = B.Lexicon.build([(w, [i, i + 1]) for i, w in enumerate(words)])
    assert len(lex.final) < sum(map(len, words)) / 2
    (tmp_path / "x").write_bytes(lex.to_bytes())
    lex = B.Lexicon.mapped(str(tmp_path / "x"))
    for w, n in zip(words, lex.find(words).tolist(), strict=True):
        assert lex.ids[lex.offsets[n] : lex.offsets[n + 1]].tolist() == [words.index(w), words.index(w) + 1]
    assert lex.find([b"talk", b"alking", b"x", b"walkings"]).tolist() == [-1] * 4
    assert B.Lexicon.build([]).find([b"x", b""]).tolist() == [-1, -1]


KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])


def test_round_trip_and_hard_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (1, "the same", None), (1, "the same", None)]
    got = B.decode(B.encode(spark.createDataFrame(rows, KIND).repartition(3), lexicon_words=50)).collect()
    assert sorted((str(r.doc_id), r.ids, r.text) for r in got) == sorted((str(i), ids_of(t), t or "") for i, t, _ in rows)


def test_frequent_words(spark):
    text = " a" * 1000 + " b" * 500 + " c" * 90 + " d" * 4 + " e" * 3
    docs = spark.createDataFrame([(text,), (text,), (None,)], "text string")
    assert B.frequent_words(docs, 10) == [" a", " b", " c", " d", " e"]
    assert B.frequent_words(docs, 2) == [" a", " b"] and B.frequent_words(docs, 0) == []


def test_empty_table(spark):
    assert B.decode(B.encode(spark.createDataFrame([], KIND))).collect() == []


def test_decode_replaces_broken_bytes(spark):
    ids = [MODEL.byte_ids[0xE9], MODEL.byte_ids[0x41], 50256]
    got = B.decode(spark.createDataFrame([(1, [int(i) for i in ids]), (2, None)], "doc_id long, ids array<int>")).collect()
    assert [r.text for r in got] == [LIBRARY.decode([int(i) for i in ids], skip_special_tokens=False), ""]


def test_query_equals_library(spark, sf):
    from weftline.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op9_bpe_encoding_decoding"](spark, sf).collect():
        ids = ids_of(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
