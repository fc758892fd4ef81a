"""Cross-entropy difference of target and background bigram models over one vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Share of the bigram estimate; the rest is the unigram's.
BIGRAM_SHARE = 0.7
#: What each word of the vocabulary, and one for unknown words, counts besides its occurrences.
ADDED = 0.1
#: Bytes of text, and documents, of a chunk: what is counted in one piece. A longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 1 << 16
#: Bytes of text of a group: that many for each byte of the root of the corpus's bytes, and at least `GROUP_BYTES`.
PER_ROOT, GROUP_BYTES = 100, 8 << 20

_START, _END = "<s>", "</s>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sequence(text: str | None) -> list[str]:
    """What the models see of a text: its lower-cased words between marks. No word can be a mark: marks have a white space in front."""
    return [" " + _START, *(text or "").lower().split(), " " + _END]


def loss(count: float, before: float, single: float, total: float, vocabulary: int) -> float:
    """-log2 of a word's probability, from the counts of the bigram, its first word, the word, all words, and the size of the vocabulary."""
    alone = (single + ADDED) / (total + ADDED * (vocabulary + 1))
    return -math.log2(BIGRAM_SHARE * count / before + (1 - BIGRAM_SHARE) * alone) if before else -math.log2(alone)


class Counted:
    """The words of a group of texts as keys: of each token, and of each pair of neighbours. The lowest bit of a key tells which."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        number: dict[str, int] = {}
        rows = [np.array([number.setdefault(w, len(number)) for w in sequence(t)], np.int64) for t in texts]
        hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in number], np.uint64)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        words = np.concatenate(rows)
        self.text = np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)
        self.first = np.ones(len(words), bool)
        self.first[1:] = self.text[1:] != self.text[:-1]
        with np.errstate(over="ignore"):
            single = hashes[words] & ~np.uint64(1)
            pair = np.zeros_like(single)
            pair[1:] = (single[:-1] * _MIX ^ single[1:] >> np.uint64(7)) * _MIX + single[1:]
            pair = (pair ^ pair >> np.uint64(29)) * _MIX | np.uint64(1)
        listed = np.concatenate([single, pair[~self.first]])
        self.keys, place = np.unique(listed, return_inverse=True)
        place = place.astype(np.int32)
        self.single = place[: len(words)]
        self.pair = np.zeros(len(words), np.int32)
        self.pair[~self.first] = place[len(words) :]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key is in texts of the target, and of the background."""
        there = target[self.text]
        out = []
        for wanted in (there, ~there):
            single, pair = self.single[wanted], self.pair[wanted & ~self.first]
            out.append(np.bincount(single, minlength=len(self.keys)) + np.bincount(pair, minlength=len(self.keys)))
        return out[0], out[1]

    def losses(self, target: np.ndarray, counts: tuple[np.ndarray, np.ndarray], totals: tuple[float, float], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean loss per token of each text under both models. A text's own words don't count in the model that it is part of."""
        at = np.flatnonzero(~self.first)
        text, single, pair, before = self.text[at].astype(np.int64), self.single[at], self.pair[at], self.single[at - 1]

        def own(texts: np.ndarray, keys: np.ndarray, by: np.ndarray) -> np.ndarray:
            """How often each of `by` is among `keys` in its own text."""
            listed, n = np.unique(texts.astype(np.int64) << 32 | keys, return_counts=True)
            want = text << 32 | by
            place = np.minimum(np.searchsorted(listed, want), len(listed) - 1)
            return np.where(listed[place] == want, n[place], 0)

        own_single, own_before, own_pair = own(self.text, self.single, single), own(self.text, self.single, before), own(text, pair, pair)
        out = []
        for k, inside in enumerate((target, ~target)):
            mine = inside[text]
            c = counts[k]
            total = totals[k] - mine * self.sizes[text]
            alone = (c[single] - mine * own_single + ADDED) / (total + ADDED * (vocabulary + 1))
            ahead = c[before] - mine * own_before
            follows = np.divide(c[pair] - mine * own_pair, ahead, out=np.zeros(len(at)), where=ahead > 0)
            p = np.where(ahead > 0, BIGRAM_SHARE * follows + (1 - BIGRAM_SHARE) * alone, alone)
            out.append(np.bincount(text, -np.log2(p), minlength=len(self.sizes)) / (self.sizes - 1))
        return out[0], out[1]


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket's keys begin: buckets are ranges of keys, which are hashes."""
    edges = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _squeeze(x: np.ndarray) -> bytes:
    """An array of numbers compressed by planes of bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def _expand(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def group_count(total: int, least: int = GROUP_BYTES) -> int:
    """How many groups, and how many buckets, a corpus of so many bytes has."""
    return max(1, -(-total // max(least, PER_ROOT * math.isqrt(total))))


def _pack(ids: list, raw: list[bytes], kind: pa.DataType, chunk: int) -> pa.RecordBatch:
    """A row with a chunk's ids, the sizes of its texts, and the texts compressed as one."""
    import zstandard

    sizes = [len(x) for x in raw]
    data = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
    values = ([chunk], [ids], [sizes], [data], [sum(sizes)])
    kinds = (pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], ["chunk", "ids", "sizes", "data", "bytes"])


def _chunks(table: pa.Table) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """(ids, texts, target flags) of each chunk of a group, in the order of their numbers."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    held: dict[int, tuple] = {}
    wanted: dict[int, list[int]] = {}
    for role, chunk, ids, sizes, data, places in zip(*(table[c] for c in ("role", "chunk", "ids", "sizes", "data", "places")), strict=True):
        if role.as_py() == 0:
            held[chunk.as_py()] = (ids, sizes, data)
        elif role.as_py() == 1:
            wanted[chunk.as_py()] = places.as_py()
    for chunk in sorted(held):
        ids, sizes, data = held[chunk]
        raw, ends = unpack(data.as_py()), np.cumsum([0, *sizes.as_py()]).tolist()
        flags = np.zeros(len(ends) - 1, bool)
        flags[wanted.get(chunk, [])] = True
        yield ids.as_py(), [raw[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)], flags


def score_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, in_target, n_tokens, target_loss, background_loss, loss_difference) of each whole text.

    The documents whose ids `target` (doc_id) lists make the target model, all
    others the background model: bigrams interpolated with unigrams, matched in
    everything but their texts, over the vocabulary of both. The losses are
    bits per token, end mark included; the difference, target less background,
    is lower the more a text is like the target. A text's own counts are taken
    out of the model that it is part of, so that no text vouches for itself.

    Each task packs its documents into chunks of some megabytes, which are
    written once: `docs` is evaluated only here, and the bytes of all texts are
    known exactly after. Chunks are dealt into groups. A group sends each of
    its n-grams once, as 64-bit keys with two counts, into as many buckets of
    the key space as there are groups, where the counts of all groups are
    added; it gets the sums back in the same order. So what is gathered grows
    with the corpus, no task holds more than a bucket or a group, and no
    frequent word has a row of its own more than once for each group.

    Groups and buckets grow with the root of the corpus, so that a pair of
    both, which is a row, has over a thousand keys at any size: a group has 17
    MB of text at 30 GB, and 1 GB at 100 TB, where a task takes some 5 GB.

    Null text counts as empty, whose only token is the end mark; repeated rows
    and null ids stay (null ids are background); a text of any length is
    counted whole, by one task; a target that lists nothing gives a target loss
    of the empty model; an empty table gives no rows; other columns are ignored.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, size, chunk, kind = [], [], 0, TaskContext.get().partitionId() << 32, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw.append((x.as_py() or "").encode())
                ids.append(i)
                size += len(raw[-1])
                if size >= CHUNK_BYTES or len(raw) >= CHUNK_ROWS:
                    yield _pack(ids, raw, kind, chunk)
                    ids, raw, size, chunk = [], [], 0, chunk + 1
        if raw:
            yield _pack(ids, raw, kind, chunk)

    none = lambda kind: F.lit(None).cast(kind)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    packed = settle(chosen.mapInArrow(pack, f"chunk long, ids array<{id_kind}>, sizes array<long>, data binary, bytes long"))
    groups = group_count(packed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n, group_bytes)
    of_chunk = F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("g")

    # where in its chunk each document of the target is: ids alone are shuffled
    listed = target.where("doc_id is not null").select(F.col("doc_id").cast(id_kind).alias("id")).distinct()
    places = packed.select("chunk", F.posexplode("ids").alias("place", "id")).where("id is not null").join(listed, "id")
    flags = settle(places.groupBy("chunk").agg(F.collect_list("place").alias("places")))
    columns = {"role": "int", "chunk": "long", "ids": f"array<{id_kind}>", "sizes": "array<long>", "data": "binary", "places": "array<int>", "bucket": "int", "more": "binary"}

    def rows(source: DataFrame, group: Column, role: int, *filled: str) -> DataFrame:
        return source.select(group, F.lit(role).alias("role"), *(F.col(c) if c in filled else none(k).alias(c) for c, k in columns.items() if c != "role"))

    texts = rows(packed, of_chunk, 0, "chunk", "ids", "sizes", "data").union(rows(flags, of_chunk, 1, "chunk", "places"))

    def send(table: pa.Table) -> pa.Table:
        g, found = table["g"][0].as_py(), []
        for _, batch, wanted in _chunks(table):
            counted = Counted(batch)
            found.append((counted.keys, *counted.counts(wanted)))
        keys, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        counts = [np.bincount(place, np.concatenate([f[k] for f in found]), minlength=len(keys)).astype(np.uint64) for k in (1, 2)]
        cuts, sent = _buckets(keys, groups), []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            sent.append((b, g, _squeeze(np.concatenate([keys[part][:1], np.diff(keys[part])])), _squeeze(counts[0][part]), _squeeze(counts[1][part])))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*sent, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "g", "keys", "target", "background"])

    def add(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys = [np.cumsum(_expand(x.as_py(), np.uint64), dtype=np.uint64) for x in table["keys"]]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([_expand(x.as_py(), np.uint64) for x in table[c]]), minlength=len(known)).astype(np.uint64) for c in ("target", "background")]
        single = (known & np.uint64(1)) == 0
        out = [(None, bucket, None, None, int(single.sum()), int(sums[0][single].sum()), int(sums[1][single].sum()))]
        ends = np.cumsum([0, *map(len, keys)])
        for g, a, b in zip(table["g"].to_pylist(), ends, ends[1:], strict=False):
            out.append((g, bucket, _squeeze(sums[0][place[a:b]]), _squeeze(sums[1][place[a:b]]), None, None, None))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "bucket", "data", "more", "words", "in_target", "in_background"])

    sent = texts.groupBy("g").applyInArrow(send, "bucket int, g int, keys binary, target binary, background binary")
    back = settle(sent.groupBy("bucket").applyInArrow(add, "g int, bucket int, data binary, more binary, words long, in_target long, in_background long"))
    sums = back.where("g is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "in_target", "in_background"))).first()
    vocabulary, totals = sums.words, (sums.in_target, sums.in_background)

    def judge(table: pa.Table) -> pa.Table:
        held = [(ids, wanted, Counted(batch)) for ids, batch, wanted in _chunks(table)]
        keys = np.unique(np.concatenate([c.keys for _, _, c in held]))
        parts = {b: (data, more) for role, b, data, more in zip(*(table[c].to_pylist() for c in ("role", "bucket", "data", "more")), strict=True) if role == 2}
        counts = [np.concatenate([_expand(parts[b][k], np.uint64) for b in sorted(parts)]).astype(np.float64) for k in (0, 1)]
        out = []
        for ids, wanted, counted in held:
            at = np.searchsorted(keys, counted.keys)
            target_loss, background_loss = counted.losses(wanted, (counts[0][at], counts[1][at]), totals, vocabulary)
            values = (ids, wanted, counted.sizes - 1, target_loss, background_loss, target_loss - background_loss)
            kinds = (table.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), *[pa.float64()] * 3)
            out.append(pa.Table.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], ["doc_id", "in_target", "n_tokens", "target_loss", "background_loss", "loss_difference"]))
        return pa.concat_tables(out)

    returned = rows(back.where("g is not null"), F.col("g"), 2, "data", "bucket", "more")
    out = f"doc_id {id_kind}, in_target boolean, n_tokens long, target_loss double, background_loss double, loss_difference double"
    return texts.union(returned).groupBy("g").applyInArrow(judge, out)
