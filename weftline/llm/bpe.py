"""Byte-level BPE: a memory-mapped transducer for frequent words, exact merges for the others."""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, shared_dir, slices

#: How the byte-level tokenizer parts a text into words (a fixed value of its format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with alternatives that can't both begin at one place in another order, and for texts without UNSAFE in Python's own classes, which is faster.
_WORDS = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE_WORDS = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: What isn't Latin up to U+024F or general punctuation, and what the classes differ on: U+001C to U+001F, superscript digits and fractions.
_UNSAFE = r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]"
#: Words in the lexicon. Others are merged, so that this bounds memory and changes no result.
LEXICON_WORDS = 1 << 16
#: Occurrences of the rarest word in it.
LEAST_COUNT = 4
#: Bytes of the longest word in the lexicon, or merged together with others.
SHORT_WORD = 32
#: Distinct words that a task remembers before it begins anew.
REMEMBERED = 250_000
#: The rank of a pair that isn't merged.
NONE = np.int32(1 << 30)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The format's letters for bytes: printable Latin-1 stands for itself, the rest for letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Model:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in piece)
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.pair_into = keys[order], order.astype(np.int32), into[order]
        self.piece_ends = np.cumsum([len(p) for p in self.pieces])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)

    @functools.cached_property
    def ranked(self) -> dict[int, tuple[int, int]]:
        return {k: (r, t) for k, r, t in zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), self.pair_into.tolist(), strict=True)}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is none or an id is negative."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], NONE)

    @functools.cached_property
    def by_rank(self) -> np.ndarray:
        out = np.empty_like(self.pair_into)
        out[self.pair_ranks] = self.pair_into
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merges of one word of any length, by a heap over a linked list."""
        ids = [int(self.byte_ids[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranked = self.ranked
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := ranked.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        offer = lambda i, j: heapq.heappush(heap, (m[0], i, m[1], ids[i], ids[j])) if (m := ranked.get(ids[i] << 32 | ids[j])) else None
        while heap:
            _, i, into, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = into, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word): exact merges, of short words together. Each round merges the first best pair of every word."""
        sizes = np.array([len(w) for w in words], np.int64)
        parts, owners = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
            parts.append(np.array(self.merge_long(words[i]), np.int32))
            owners.append(np.full(len(parts[-1]), i))
        short = np.argsort(sizes, kind="stable")[: int((sizes <= SHORT_WORD).sum())]
        for at in range(0, len(short), 16384):
            some = short[at : at + 16384]
            width = max(1, int(sizes[some].max()))
            columns = np.arange(width + 1)
            ids = np.full((len(some), width + 1), -1, np.int32)
            ids[columns < sizes[some][:, None]] = self.byte_ids[np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8)]
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(some))
            row, ranks = ids, rank
            while True:
                best = ranks.argmin(axis=1)
                least = ranks[np.arange(len(live)), best]
                on = least < NONE
                ids[live[~on]] = row[~on]
                if not on.any():
                    break
                live, row, ranks, best, least = live[on], row[on], ranks[on], best[on], least[on]
                each = np.arange(len(live))
                shift = np.minimum(columns + (columns > best[:, None]), width)
                row = np.take_along_axis(row, shift, 1)
                row[:, -1] = -1
                row[each, best] = self.by_rank[least]
                ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 1), 1)
                ranks[:, -1] = NONE
                ranks[each, best] = self.ranks(row[each, best], row[each, best + 1])
                left = np.flatnonzero(best > 0)
                ranks[left, best[left] - 1] = self.ranks(row[left, best[left] - 1], row[left, best[left]])
            there = ids >= 0
            parts.append(ids[there])
            owners.append(np.repeat(some, there.sum(axis=1)))
        order = np.argsort(owner := np.concatenate(owners), kind="stable")
        return np.concatenate(parts)[order], np.bincount(owner, minlength=len(words)).astype(np.int64)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, bytes of each id) of the pieces."""
        ends = self.piece_ends[ids]
        sizes = ends - np.where(ids > 0, self.piece_ends[ids - 1], 0)
        return self.piece_bytes[_ranges(ends - sizes, sizes)], sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for sizes[0] numbers, then the same from starts[1] on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lexicon:
    """A minimal acyclic automaton over words. Arc outputs add up to the word's number, which has ids as output."""

    PARTS = ("arcs", "targets", "outputs", "final", "offsets", "ids")

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def build(cls, words: Iterable[tuple[bytes, list[int]]]) -> Lexicon:
        """Words with their ids. Suffixes are shared as words come in order: what the next word can't change is looked up among the states there are."""
        entries = sorted(words)
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        known: dict[tuple, int] = {}

        def fix(state: tuple[bool, tuple]) -> int:
            if (at := known.get(state)) is None:
                at = known[state] = len(states)
                states.append(state)
            return at

        path: list[list] = [[False, []]]
        last = b""

        def shorten(to: int) -> None:
            while len(path) > to + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], fix((final, tuple(arcs)))))

        for word, _ in entries:
            same = next((i for i, (x, y) in enumerate(zip(word, last, strict=False)) if x != y), min(len(word), len(last)))
            shorten(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        shorten(0)
        root = fix((path[0][0], tuple(path[0][1])))
        below = []  # words from each state on; arcs lead to states that came before
        for final, arcs in states:
            below.append(final + sum(below[t] for _, t in arcs))
        arcs, targets, outputs = [], [], []
        for s, (final, out) in enumerate(states):
            passed = int(final)
            for letter, t in out:
                arcs.append(s << 8 | letter)
                targets.append(t)
                outputs.append(passed)
                passed += below[t]
        return cls(
            arcs=np.array([root, *arcs], np.int64),  # the first is the root, no arc
            targets=np.array(targets, np.int32),
            outputs=np.array(outputs, np.int32),
            final=np.array([f for f, _ in states], np.uint8),
            offsets=np.cumsum([0, *(len(ids) for _, ids in entries)]).astype(np.int64),
            ids=np.array([i for _, ids in entries for i in ids], np.int32),
        )

    @classmethod
    def compile(cls, words: list[bytes], model: Model) -> Lexicon:
        """The words with the ids that the model merges them to."""
        ids, counts = model.merge(words)
        return cls.build(zip(words, (x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])), strict=True) if words else [])

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, k)) for k in self.PARTS]
        pads = [p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts]
        head = json.dumps([[str(p.dtype), len(p), sum(map(len, pads[:i]))] for i, p in enumerate(parts)]).encode()
        head += b" " * (-len(head) % 8)
        return np.int64(len(head)).tobytes() + head + b"".join(pads)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The parts as views of the memory-mapped file."""
        raw = np.memmap(path, np.uint8, "r")
        start = 8 + int(raw[:8].view(np.int64)[0])
        spec = json.loads(raw[8:start].tobytes())
        return cls(**{k: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in zip(cls.PARTS, spec, strict=True)})

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon hasn't it. All words take a step at once."""
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(words), np.uint8)
        arcs = np.asarray(self.arcs[1:])
        state, number = np.full(len(words), int(self.arcs[0]), np.int64), np.zeros(len(words), np.int64)
        if not len(arcs):
            state[sizes > 0] = -1
        at = np.flatnonzero((sizes > 0) & (sizes <= SHORT_WORD) & (state >= 0))
        state[sizes > SHORT_WORD] = -1
        for step in range(SHORT_WORD):
            at = at[sizes[at] > step]
            if not len(at):
                break
            want = state[at] << 8 | flat[starts[at] + step]
            arc = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
            ok = arcs[arc] == want
            state[at[~ok]] = -1
            at, arc = at[ok], arc[ok]
            state[at] = self.targets[arc]
            number[at] += self.outputs[arc]
        return np.where((state >= 0) & (self.final[state] > 0), number, -1)


def word_splitter() -> Callable[[str], list[str]]:
    """The words of a text, as WORDS parts it."""
    import regex

    unsafe, safe, every = re.compile(_UNSAFE).search, re.compile(_SAFE_WORDS).findall, regex.compile(_WORDS).findall
    return lambda text: every(text) if unsafe(text) else safe(text)


class Encoder:
    """Encodes whole texts: remembered words, then the lexicon, then merges."""

    def __init__(self, model: Model, lexicon: Lexicon | None, source: str):
        self.model, self.lexicon, self.source = model, lexicon, source
        self.words = word_splitter()
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(model.special, key=len, reverse=True)) + ")") if model.special else None
        self._library = None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.sizes = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.odd: set[str] = set()

    def library(self, text: str) -> list[int]:
        """The library's own ids, for texts with letters that are newer than this Python's Unicode tables."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library.encode(text, add_special_tokens=False).ids

    def split(self, text: str) -> list[str]:
        if self.special is None or "<" not in text and not self.special.search(text):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.words(part)
        return out

    def learn(self, new: list[str]) -> None:
        odd = {c for c in set("".join(w for w in new if not w.isascii())) if unicodedata.category(c) == "Cn"}
        if odd:
            self.odd.update(w for w in new if not odd.isdisjoint(w))
        raw = [w.encode() for w in new]
        place = np.full(len(new), -1, np.int64) if self.lexicon is None else self.lexicon.find(raw)
        special = [i for i, w in enumerate(new) if w in self.model.special]
        place[special] = -1
        rest = np.flatnonzero(place < 0).tolist()
        ids, counts = self.model.merge([raw[i] for i in rest])
        at, more = len(self.number), np.empty(len(new), np.int64)
        more[rest] = counts
        if self.lexicon is not None:
            first = self.lexicon.offsets[np.maximum(place, 0)]
            more[place >= 0] = (self.lexicon.offsets[np.maximum(place, 0) + 1] - first)[place >= 0]
        total = int(more.sum())
        while self.used + total > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        while at + len(new) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        starts = self.used + np.cumsum(more) - more
        self.sizes[at : at + len(new)], self.starts[at : at + len(new)] = more, starts
        self.table[_ranges(starts[rest], more[rest])] = ids
        if self.lexicon is not None:
            known = place >= 0
            self.table[_ranges(starts[known], more[known])] = self.lexicon.ids[_ranges(first[known], more[known])]
        for i in special:  # one id instead of what was merged
            self.table[starts[i]], self.sizes[at + i] = self.model.special[new[i]], 1
        self.used += total
        self.number.update(zip(new, range(at, at + len(new)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if len(self.number) > REMEMBERED:
            self.forget()
        parted = [self.split(t) for t in texts]
        if new := list(set(chain.from_iterable(parted)).difference(self.number)):
            self.learn(new)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parted)), np.int64, sum(map(len, parted)))
        sizes = self.sizes[at]
        ids = self.table[_ranges(self.starts[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, parted)])]
        counts = np.diff(ends)
        if self.odd:
            spots = [i for i, words in enumerate(parted) if not self.odd.isdisjoint(words)]
            if spots:
                pieces = np.split(ids, ends[1:-1])
                for i in spots:
                    pieces[i] = np.array(self.library(texts[i]), np.int32)
                ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        return ids, counts


@functools.lru_cache(maxsize=2)
def _model(source: str) -> Model:
    return Model(source)


@functools.lru_cache(maxsize=2)
def _encoder(source: str, name: str) -> Encoder:
    return Encoder(_model(source), Lexicon.mapped(SparkFiles.get(name)), source)


def _chunks(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` bytes, null as empty, with the place of the first."""
    some: list[str] = []
    at = held = 0
    for i, x in enumerate(texts):
        some.append(x.as_py() or "")
        held += len(some[-1])
        if held >= most:
            yield at, some
            some, held, at = [], 0, i + 1
    if some:
        yield at, some


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, each run without white space counted with a space before it; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = word_splitter(), Counter()

        def told() -> pa.RecordBatch:
            short: Counter = Counter()
            for run, n in seen.items():
                for w in words(f" {run}"):
                    if len(w) <= SHORT_WORD:
                        short[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for x in batch.column(0):
                seen.update((x.as_py() or "").split())
                if len(seen) > REMEMBERED:
                    yield told()
                    seen.clear()
        yield told()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, `words` of them at most, and none that comes fewer than LEAST_COUNT times.

    Counts fall into classes, eight for each doubling. The classes with most
    are taken as long as their words are few enough; so only as many words as
    that leave the executors, and no task sorts or sends more.
    """
    grade = F.floor(F.log2("n") * 8).cast("int")
    counted = settle(word_counts(docs, text_col).where(F.col("n") >= LEAST_COUNT).withColumn("grade", grade))
    taken, lowest = 0, None
    for r in counted.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("grade")).collect():  # a few hundred classes at most
        taken += r.n
        if taken > words:
            break
        lowest = r.grade
    if lowest is None:
        return []
    return sorted(r.word for r in counted.where(F.col("grade") >= lowest).select("word").collect())


def share_lexicon(spark: SparkSession, lexicon: Lexicon) -> str:
    """Put the automaton into the shared folder and have Spark give each executor a copy to map; its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftline/{name}")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(place)
    data = lexicon.to_bytes()
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    fs.deleteOnExit(place)
    spark.sparkContext.addFile(fs.makeQualified(place).toString())
    return name


def encode(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text as the tokenizers library encodes it without special tokens.

    The words of all documents are counted; the most frequent are compiled with
    their ids into a minimal acyclic transducer, which executors map into
    memory from a file that Spark hands out. A task looks up new words there,
    merges the rest exactly, and remembers both. A text with a code point that
    this Python's Unicode tables don't assign goes to the library itself, whose
    tables may be newer.

    Null text counts as empty, with no ids; the special token's own string
    becomes its id, as in the library; repeated rows and null ids stay; a text
    of any length is encoded whole, by one task; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    source = open(path or default_path(), encoding="utf-8").read()
    model = _model(source)
    frequent = [w.encode() for w in frequent_words(docs, lexicon_words, text_col)]
    name = share_lexicon(spark, Lexicon.compile(frequent, model))
    held = spark.sparkContext.broadcast(source)  # a vocabulary file: its size doesn't follow the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, name)
        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                ids, counts = encoder.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` (doc_id, ids) with the text that the ids stand for; broken UTF-8 becomes U+FFFD, null ids an empty text.

    Repeated rows and null ids of documents stay; lists are decoded some
    megabytes at a time, a longer one alone; an empty table gives no rows;
    other columns are left out.
    """
    held = encoded.sparkSession.sparkContext.broadcast(open(path or default_path(), encoding="utf-8").read())

    def told(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        data, sizes = model.bytes_of(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
        raw = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(data)])
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), lists, text], ["doc_id", "ids", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in batches:
            for part in slices(batch, 1, 256):
                yield told(model, part)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
