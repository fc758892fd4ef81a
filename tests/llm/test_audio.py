import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import types as T

from weftline.llm import audio as A

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("media", T.StringType()), T.StructField("feature", T.LongType())])


def plain_mulaw(code):
    code = ~code & 255
    size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33
    return (-1 if code & 128 else 1) * 4 * size


def plain_alaw(code):
    code ^= 0x55
    segment, low = code >> 4 & 7, code & 15
    size = (2 * low + 1) * 8 if segment == 0 else (2 * low + 33) << (segment + 2)
    return size if code & 128 else -size


def plain_adpcm(block):
    at, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [at]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(A.STEPS[index])
            size = step >> 3
            size += (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            at = max(-32768, min(32767, at - size if code & 8 else at + size))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(at)
    return out


def plain_resampled(samples):
    """Each sample, then the point halfway to the next by the taps, one at a time."""
    taps, out = A.HALF.tolist(), []
    for n, x in enumerate(samples):
        total = 1 << 13
        for k, tap in enumerate(taps):
            at = n + k - (len(taps) // 2 - 1)
            total += tap * (samples[at] if 0 <= at < len(samples) else 0)
        out += [x, max(-32768, min(32767, total >> 14))]
    return out


def plain_feature(payload):
    """The feature by loops over single samples."""
    told = []
    for name, samples in (
        ("mulaw", [plain_mulaw(b) for b in payload]),
        ("alaw", [plain_alaw(b) for b in payload]),
        ("adpcm", [x for i in range(0, len(payload), 576) for x in plain_adpcm(payload[i : i + 576])]),
    ):
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
        pcm = b"".join(x.to_bytes(2, "little", signed=True) for x in plain_resampled(samples))
        told.append(f"{name}:{(sum(x * x for x in samples) / len(samples)) ** 0.5:.3f}:{crossings}:{max(map(abs, samples))}:{zlib.crc32(pcm):08x}")
    return "|".join(told)


def test_tables():
    assert A.MULAW.tolist() == [plain_mulaw(i) for i in range(256)]
    assert A.ALAW.tolist() == [plain_alaw(i) for i in range(256)]
    assert sorted(set(A.MULAW.tolist()))[0] == -32124 and sorted(set(A.ALAW.tolist()))[-1] == 32256


def test_adpcm_equals_plain():
    blocks = np.frombuffer(random.Random(1).randbytes(576 * 7), np.uint8).reshape(7, 576)
    assert A.adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]
    assert A.adpcm(blocks[:0]).shape == (0, 1145)


def test_resampling_keeps_samples_and_a_constant():
    x = np.array([0, 100, -32768, 32767, 5], np.int16)
    assert A.resample(x)[::2].tolist() == x.tolist() and A.HALF.sum() == 1 << 14
    assert set(A.resample(np.full(100, 12345, np.int16))[16:-16].tolist()) == {12345}
    assert A.resample(np.full(40, -32768, np.int16)).min() == -32768


def test_wav_round_trip():
    for codec in A.TAGS:
        for text in ("", None, "x" * 575, "x" * 576, "é" * 600):
            payload = A.payload_of(text)
            assert len(payload) % 576 == 0 < len(payload) and payload.rstrip(b"\xff") == (text or "").encode()
            assert A.from_wav(A.to_wav(payload, codec)) == (codec, 8000, payload)
    for broken in (b"", b"RIFF", A.to_wav(b"ab" * 288)[:100]):
        try:
            A.from_wav(broken)
            raise AssertionError
        except ValueError:
            pass


def test_hard_rows(spark):
    rows = [(1, "tie", "x", 1), (1, "tie", "x", 1), (None, None, None, None), (2, "", "", 2), (3, "ü" * 90_000, "", 3)]
    got = A.decode_audio(A.store_audio(spark.createDataFrame(rows, KIND))).collect()
    assert sorted((str(r.doc_id), bytes(r.payload)) for r in got) == sorted((str(r[0]), A.payload_of(r[1])) for r in rows)
    assert all(np.frombuffer(bytes(r.pcm), "<i2")[::2].tolist() == [plain_mulaw(b) for b in bytes(r.payload)] for r in got)
    assert len({r.feature for r in got if not r.n_bytes}) == 1 and len({r.feature for r in got}) == 3


def test_media_that_is_no_audio(spark):
    got = A.decode_audio(spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id long, media binary")).collect()
    assert all(r.payload is None and r.feature is None and r.pcm is None for r in got)


def test_empty_table(spark):
    assert A.decode_audio(A.store_audio(spark.createDataFrame([], KIND))).collect() == []


def test_query(spark, sf):
    from weftline.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op10_media_columns"](spark, sf).collect()
    assert len(got) == len(docs)
    longest = max(len(t or "") for t in docs.values())
    for r in got:
        payload = A.payload_of(docs[r.doc_id])
        if len(payload) <= 1152 or len(docs[r.doc_id] or "") == longest:
            assert r.feature == plain_feature(payload)
            assert np.frombuffer(bytes(r.pcm), "<i2").tolist() == plain_resampled([plain_mulaw(b) for b in payload])
        media = A.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(docs[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
