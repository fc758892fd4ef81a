"""Telephony audio columns: G.711 and IMA ADPCM in WAV, decoded in numpy and resampled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BATCH_BYTES, slices

#: Bytes of an ADPCM block, and what payloads are padded to a multiple of.
BLOCK = 576
PAD = b"\xff"
RATE = 8000
#: WAV format tags (fixed values).
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: IMA ADPCM's step sizes and the changes of their index by a code's magnitude (fixed values).
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def _half_taps(taps: int = 8, scale: int = 1 << 14) -> np.ndarray:
    """Integer taps of the point halfway between two samples: a windowed sinc that adds up to `scale`."""
    x = np.arange(taps) - (taps - 1) / 2
    wanted = np.sinc(x) * np.cos(np.pi * x / (taps + 1)) ** 2
    out = np.round(wanted / wanted.sum() * scale).astype(np.int64)
    out[taps // 2 - 1] += (scale - out.sum()) // 2
    out[taps // 2] += scale - out.sum()
    return out


HALF = _half_taps()


def expand(payload: bytes, codec: str) -> np.ndarray:
    """16-bit samples of G.711 bytes, by table."""
    return (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, np.uint8)]


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of IMA ADPCM mono blocks (rows of bytes), a row for each: all blocks take a step at once."""
    n, width = blocks.shape
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    at = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = at
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        code = (codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15).astype(np.int32)
        step = STEPS[index]
        size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        at += np.where(code & 8, -size, size)
        np.clip(at, -32768, 32767, out=at)
        index += MOVES[code & 7]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = at
    return np.ascontiguousarray(out.T)


def resample(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the point halfway to the next; silence before and after."""
    taps = len(HALF)
    wide = np.zeros(len(samples) + taps - 1, np.int32)
    wide[taps // 2 - 1 : taps // 2 - 1 + len(samples)] = samples
    between = np.full(len(samples), 1 << 13, np.int32)
    for k, tap in enumerate(HALF.tolist()):
        between += wide[k : k + len(samples)] * np.int32(tap)
    between >>= 14
    np.clip(between, -32768, 32767, out=between)
    out = np.empty(2 * len(samples), "<i2")
    out[0::2], out[1::2] = samples, between
    return out


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text, padded to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)


def to_wav(payload: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A mono WAV file with the payload as its data."""
    if codec == "adpcm":
        per_block = 2 * (BLOCK - 4) + 1
        head = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        head, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0), len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    body += b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, payload) of a WAV file; ValueError if it is none, or of another kind."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            codec = next((k for k, v in TAGS.items() if v == tag), None)
            if codec is None or at + 8 + size > len(media):
                break
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data of a known kind")


def features_of(name: str, samples: np.ndarray, pcm: bytes) -> str:
    """Root mean square, zero crossings, peak, and checksum of the resampled PCM."""
    wide = samples.astype(np.int64)
    power = int((wide * wide).sum())
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"{name}:{(power / max(1, len(samples))) ** 0.5:.3f}:{crossings}:{int(np.abs(wide).max(initial=0))}:{zlib.crc32(pcm):08x}"


def store_audio(docs: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes, padded to blocks, as the samples of a WAV file.

    Null text is stored as empty, one block of padding; equal texts give equal
    files; repeated rows and null ids stay; texts are taken some megabytes at a
    time, a longer one alone (WAV holds 4 GB at most); an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, media = [], []
                for x in part.column(1):
                    text = x.as_py() or ""
                    sizes.append(len(text.encode()))
                    media.append(to_wav(payload_of(text), codec))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def decode_audio(stored: DataFrame) -> DataFrame:
    """`stored` with payload (the data read back), feature, and pcm (16-bit little-endian at twice the rate).

    pcm is that of the file's own codec. The feature describes the payload as
    mu-law, as A-law and as ADPCM blocks, each expanded or decoded, and
    resampled. A row whose media is null or no such WAV file has nulls there;
    repeated rows stay; files are decoded about a megabyte at a time, a longer
    one alone; an empty table gives no rows. Columns named payload, feature or
    pcm are an error.
    """

    def told(part: pa.RecordBatch, at: int) -> pa.RecordBatch:
        read: list[tuple[str, int, bytes] | None] = []
        for x in part.column(at):
            try:
                read.append(from_wav(x.as_py()) if x.is_valid else None)
            except ValueError:
                read.append(None)
        whole = [r[2][: len(r[2]) // BLOCK * BLOCK] if r else b"" for r in read]
        blocks = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, BLOCK)
        decoded = adpcm(blocks)
        ends = np.cumsum([0, *(len(w) // BLOCK for w in whole)])
        found, sound = [], []
        for k, r in enumerate(read):
            if r is None:
                found.append(None)
                sound.append(None)
                continue
            by = {c: expand(r[2], c) for c in ("mulaw", "alaw")} | {"adpcm": decoded[ends[k] : ends[k + 1]].ravel()}
            resampled = {c: resample(samples).tobytes() for c, samples in by.items()}
            found.append("|".join(features_of(c, by[c], resampled[c]) for c in by))
            sound.append(resampled[r[0]])
        new = [pa.array([r[2] if r else None for r in read], pa.binary()), pa.array(found, pa.string()), pa.array(sound, pa.binary())]
        return pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "payload", "feature", "pcm"])

    at = stored.columns.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, most_bytes=BATCH_BYTES // 4):  # decoded and resampled it has four to eight bytes for each
                yield told(part, at)

    if clash := {"payload", "feature", "pcm"} & set(stored.columns):
        raise ValueError(f"there are columns named {sorted(clash)}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{kinds}, payload binary, feature string, pcm binary")
