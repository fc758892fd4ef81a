"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, slices

#: Rows of the embedding table that character n-grams and words are hashed to.
BUCKETS = 1 << 17
#: Numbers in an embedding.
WIDTH = 8
#: Characters of the n-grams, of words with < and > around them.
SHORTEST, LONGEST = 3, 5
#: Words in a bag, which is averaged over so many places: a word that comes again, or a place that none takes, adds nothing. A text is as toxic as its most toxic bag, so that long texts don't thin out what one passage says.
BAG = 12
#: Most labelled documents to learn from, of each label, and bytes of their texts: those of the least hash.
MOST_PER_LABEL, MOST_BYTES = 3000, 32 << 20
#: An n-gram of words in fewer texts isn't learned: it would only tell those texts apart.
LEAST_TEXTS = 3
#: The biases that training begins with: a bag of which nothing is known is hardly toxic, so that common words needn't speak against it.
START = 4.0
#: Score from which on a text is called toxic.
THRESHOLD = 0.7
#: Distinct words that a task remembers before it begins anew.
REMEMBERED = 250_000

_EDGES = ".,;:!?\"'()[]{}<>|«»„“”…¡¿"


def tokens(text: str) -> list[str]:
    return text.lower().split()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many of each word): the hashes of a word's n-grams and of itself. Punctuation around a word is left out."""
    framed = [f"<{w.strip(_EDGES)}>" for w in words]
    letters = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in framed], np.int64)
    starts = np.cumsum(sizes) - sizes
    word_of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(letters))  # letters from here to the word's end
    prime, mix = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)
    hashes, owners = [], []
    h = np.full(len(letters), 1469598103934665603, np.uint64)
    for n in range(1, LONGEST + 1):
        there = left >= n
        moved = np.zeros_like(letters)
        moved[: max(0, len(letters) - n + 1)] = letters[n - 1 :]
        h = (h ^ moved) * prime
        if n >= SHORTEST:
            hashes.append(h[there])
            owners.append(word_of[there])
    # the whole word: the sum of its letters' hashes by place
    place = np.arange(len(letters), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    each = (letters + np.uint64(1)) * mix ^ (place + np.uint64(7)) * prime
    each = (each ^ each >> np.uint64(29)) * mix
    hashes.append(np.add.reduceat(each, starts) if len(words) else np.empty(0, np.uint64))
    owners.append(np.arange(len(words)))
    all_hashes, all_owners = np.concatenate(hashes), np.concatenate(owners)
    all_hashes = (all_hashes ^ all_hashes >> np.uint64(31)) * mix
    order = np.argsort(all_owners, kind="stable")
    return (all_hashes[order] >> np.uint64(40)).astype(np.int64) % BUCKETS, np.bincount(all_owners, minlength=len(words))


def _means(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each run of rows; no run is empty."""
    return np.add.reduceat(rows, np.cumsum(counts) - counts, axis=0) / counts.reshape(-1, *[1] * (rows.ndim - 1)).astype(rows.dtype)


def _parted(texts: list[str]) -> list[list[str]]:
    return [t if (t := tokens(x)) else [""] for x in texts]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys once each and in order; sorts them in place."""
    keys.sort()
    return keys[_begins(keys)]


def _begins(runs: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.empty(0, np.int64)


def _bags(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, bag of each, bags of each text) of texts in a row: bags of BAG neighbouring words, each word once in a bag."""
    bags_of_text = -(-counts // BAG)
    keys = np.arange(len(words))
    keys -= np.repeat(np.cumsum(counts) - counts, counts)
    keys //= BAG
    keys += np.repeat(np.cumsum(bags_of_text) - bags_of_text, counts)
    keys <<= 32
    keys |= words
    keys = _distinct(keys)
    return keys & 0xFFFFFFFF, keys >> 32, bags_of_text


def _sums(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; no run is empty."""
    return np.add.reduceat(rows, np.cumsum(counts) - counts)


def _taken(values: np.ndarray, at: np.ndarray, into: np.ndarray) -> np.ndarray:
    """values[at] written to `into`, some at a time: places are of 32 bits, and numpy would make all of them 64 at once."""
    for i in range(0, len(at), 1 << 18):
        np.take(values, at[i : i + (1 << 18)], out=into[i : i + (1 << 18)], mode="clip")
    return into


@dataclass
class Model:
    """Embeddings of the buckets, weights and biases of the two labels."""

    embeddings: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Each bucket's part in the difference of the logits: averages and the softmax of two labels are linear in it."""
        return (self.embeddings @ (self.weights[1] - self.weights[0])).astype(np.float64), float(self.biases[1] - self.biases[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str], labels: list[int], rounds: int = 250, rate: float = 0.05, spread: float = 8.0, seed: int = 11) -> Model:
    """Fit embeddings and softmax together, by gradient steps on all texts.

    A bag of words is the average of its places' embeddings, each the average
    of its n-grams'; a linear softmax of that average is how toxic the bag is,
    and its slope moves weights and embeddings at once. A text is toxic if one of its bags is: its probability is one minus the
    product of its bags' probabilities not to be (the loss is that of the
    text's label, each label weighing half). Deterministic; without texts of
    both labels the biases say so and nothing else.
    """
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights = np.array([-1, 1], np.float32)[:, None] * rng.normal(0, 0.5, WIDTH).astype(np.float32)
    biases = np.array([START, -START], np.float32)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(embeddings * 0, weights, np.array([-3, 3], np.float32) if len(y) and y.min() == 1 else np.array([3, -3], np.float32))
    number: dict[str, int] = {}
    indexed = [np.array([number.setdefault(w, len(number)) for w in tokens(x) or [""]], np.int32) for x in texts]
    counts = np.array([len(x) for x in indexed])
    words, bag_of, bags_of_text = _bags(np.concatenate(indexed), counts)
    text_of_bag = np.repeat(np.arange(len(counts), dtype=np.int32), bags_of_text)
    listed = list(number)
    del indexed, number
    key = text_of_bag[bag_of].astype(np.int64)
    key <<= 32
    key |= words
    in_texts = np.bincount(_distinct(key) & 0xFFFFFFFF, minlength=len(listed))
    del key
    # buckets of few texts stay at nothing: they, and words that have no others, needn't be gone through or held
    seen = np.zeros(BUCKETS)
    for i in range(0, len(listed), 20_000):
        buckets, per_word = features(listed[i : i + 20_000])
        seen += np.bincount(buckets, np.repeat(in_texts[i : i + 20_000], per_word), minlength=BUCKETS)
    used = np.flatnonzero(seen >= LEAST_TEXTS)
    renumbered = np.full(BUCKETS, -1, np.int32)
    renumbered[used] = np.arange(len(used))
    parts = []
    for i in range(0, len(listed), 20_000):
        buckets, per_word = features(listed[i : i + 20_000])
        buckets, owner = renumbered[buckets], np.repeat(np.arange(i, i + len(per_word), dtype=np.int32), per_word)
        parts.append((buckets[buckets >= 0], owner[buckets >= 0], per_word.astype(np.float32)))
    buckets, word_of, per_word = (np.concatenate([p[k] for p in parts]) for k in range(3))
    del parts, listed
    starts = _begins(word_of)  # n-grams come word by word
    kept = word_of[starts]
    place = np.full(len(per_word), -1, np.int32)
    place[kept] = np.arange(len(kept))
    told = place[words] >= 0
    words, bag_of, word_of, per_word = place[words[told]].astype(np.int64), bag_of[told], place[word_of], per_word[kept]
    # sums over runs: bags of their words, words of their bags, buckets of their words
    bag_starts = _begins(bag_of)
    bags = bag_of[bag_starts]
    order = np.argsort(words, kind="stable")
    bag_of_word, word_starts = bag_of[order], np.searchsorted(words[order], np.arange(len(kept)))
    key = buckets.astype(np.int64)
    key <<= 32
    key |= word_of
    del word_of, order, place, told
    key.sort()
    word_of_bucket = key.astype(np.int32)  # the lower half
    key >>= 32
    bucket_starts = np.searchsorted(key, np.arange(len(used)))
    held = np.empty(len(buckets), np.float32)  # what each n-gram of each word comes to, by word and then by bucket
    del key
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    state = [embeddings[used], weights, biases]
    first, second = [np.zeros_like(x) for x in state], [0.0] * 3
    for step in range(1, rounds + 1):
        e, w, b = state
        # averages are linear, so that the difference of the logits can be taken bucket by bucket, and its slope too
        along = w[1] - w[0]
        logits = np.full(len(text_of_bag), b[1] - b[0], np.float64)
        if len(bags):
            logits[bags] += np.add.reduceat((np.add.reduceat(_taken(e @ along, buckets, held), starts) / per_word)[words], bag_starts) / BAG
        p = np.clip(_sigmoid(logits), 1e-7, 1 - 1e-6)
        none = _sums(np.log1p(-p), bags_of_text)
        whole = np.clip(1 - np.exp(none), 1e-6, 1)
        slope = np.where(y == 1, -(1 - whole) / whole, 1) * each
        g = slope[text_of_bag] * p
        g_bucket = np.zeros(0, np.float32)
        if len(bags):
            g_words = np.add.reduceat((g / BAG).astype(np.float32)[bag_of_word], word_starts) / per_word
            g_bucket = np.add.reduceat(_taken(g_words, word_of_bucket, held), bucket_starts)
        g_along = g_bucket @ e
        slower = min(1.0, 2 * (1 - (step - 1) / rounds))
        for k, grad in enumerate((g_bucket[:, None] * along, np.stack([-g_along, g_along]), np.array([-g.sum(), g.sum()], np.float32))):
            # one scale for a whole table: n-grams of few texts, which say least, move least
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.9 * second[k] + 0.1 * float((grad**2).sum())
            size = (second[k] / (1 - 0.9**step)) ** 0.5 + 1e-12
            state[k] = (state[k] - slower * (rate if k else spread) * (first[k] / (1 - 0.9**step)) / size).astype(np.float32)
    out = np.zeros_like(embeddings)  # an n-gram that no text had says nothing
    out[used] = state[0]
    return Model(out, state[1], state[2])


class Scorer:
    """Scores whole texts; remembers what distinct words come to."""

    def __init__(self, folded: tuple[np.ndarray, float]):
        self.parts, self.bias = folded
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.values = np.empty(1 << 16)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.number) > REMEMBERED:
            self.forget()
        parted = _parted(texts)
        if new := list(set(chain.from_iterable(parted)).difference(self.number)):
            at = len(self.number)
            while at + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.empty_like(self.values)])
            for i in range(0, len(new), 20_000):
                some = new[i : i + 20_000]
                buckets, counts = features(some)
                self.values[at + i : at + i + len(some)] = _means(self.parts[buckets], counts)
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parted)), np.int64)
        words, bag_of, bags_of_text = _bags(words, np.array([len(t) for t in parted]))
        averages = _sums(self.values[words], np.bincount(bag_of)) / BAG
        return _sigmoid(np.maximum.reduceat(averages, np.cumsum(bags_of_text) - bags_of_text) + self.bias)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3. Null ids are held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, most_per_label: int = MOST_PER_LABEL, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, toxic) to learn from: the labelled documents that aren't held out, of each label at most so many, and bytes, in the order of their hashes.

    These bounds are the only sample here; rows without a label, or with one
    other than 0 and 1, aren't used, and of repeated labels the largest holds.
    A text that passes the bytes ends its label's sample; all that is learned
    from is learned whole.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_label)
        chosen = some if chosen is None else chosen.union(some)
    # two lists of bounded length, so that the documents needn't be shuffled; of repeated ids the least text counts
    rows = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of `most_per_label` rows at most
    fits = rows.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= most_bytes).select("doc_id")
    return rows.join(F.broadcast(fits), "doc_id", "left_semi")


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model that all rows (doc_id, text, toxic) make, in the order of their ids."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
    model = train([t or "" for _, t, _ in rows], [y for _, _, y in rows])
    names = ("embeddings", "weights", "biases")
    yield pa.RecordBatch.from_arrays([pa.array([getattr(model, n).astype(np.float32).tobytes()], pa.binary()) for n in names], names)


def fit(docs: DataFrame, labels: DataFrame, most_per_label: int = MOST_PER_LABEL, most_bytes: int = MOST_BYTES) -> Model:
    """Learn from `sample`, in one task: what it holds is bounded, and it is done again if its executor is lost. The model's few megabytes come to the driver."""
    rows = sample(docs, labels, most_per_label, most_bytes)
    found = rows.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(_learn, "embeddings binary, weights binary, biases binary").collect()
    if not found:
        return train([], [])
    e, w, b = (np.frombuffer(bytes(x), np.float32) for x in found[0])
    return Model(e.reshape(BUCKETS, WIDTH), w.reshape(2, WIDTH), b)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """All columns of `docs` and `into`, 0 to 1, of each whole text; null counts as empty, which has a score too.

    Repeated rows stay; texts are scored some megabytes at a time, a longer one
    alone; an empty table gives no rows; a column named `into` is an error.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.folded())  # BUCKETS numbers
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for part in slices(batch, at):
                found = scorer.scores([x.as_py() or "" for x in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, into])

    if into in docs.columns:
        raise ValueError(f"the documents have a column named {into}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{into}` double")


def toxicity(docs: DataFrame, labels: DataFrame, most_per_label: int = MOST_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document, with a model fit on those labels.

    Scores come from the text alone. Equal texts have equal scores; null and
    empty texts are scored as a bag with nothing in it; repeated rows stay; with
    no labels, or labels of one kind, every score is the same; an empty table
    gives no rows; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, most_per_label))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most_per_label: int = MOST_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """`docs`, all columns, without the documents whose score reaches the threshold; the model is fit on those labels.

    Null and empty texts are scored like any other and stay unless every text
    is called toxic; repeated rows stay or go together; an empty table gives no
    rows; other columns, whatever their names, aren't touched.
    """
    into = "toxicity" + "_" * max((len(c) for c in docs.columns), default=0)
    return score(docs, fit(docs, labels, most_per_label), into=into).where(F.col(into) < threshold).select(*docs.columns)
