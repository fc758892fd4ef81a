"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import join_facts, settle, slices

SEED = 42
#: Bits that linked fingerprints may differ in.
MOST_BITS = 3
#: Of 8 bytes, those that such fingerprints share at least.
LEAST_BYTES = 8 - MOST_BITS
#: A posting list of more fingerprints is split by further bytes. The last level leaves 12 bits free, so it has no longer lists.
LONGEST_LIST = 4096

#: Lists that a wide fingerprint is in, each of two positional bytes; of two sets with a Jaccard similarity of 0.8, 15 % of the bits
#: differ, so that two bytes are equal with 0.073 and none of the lists has both with (1 - 0.073)**160 = 5e-6.
LISTS = 160
#: Bits in which the first 128 of sets at 0.8 differ at most: 19 on average, 43 or more with 2e-7.
MOST_APART = 42
#: Entries of a list that one task has at once, about; longer lists are dealt by leading bits of their keys.
ENTRIES = 1 << 19

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8, dtype=np.intp) * 256
_WORDS = np.arange(LISTS // 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_VOTE = np.random.default_rng(SEED).integers(0, 2, 16 * LISTS)
_ENTRY = np.dtype([("key", "<u2"), ("size", "<u2"), ("bits", "<u8", 2), ("odd", "<u8", 2), ("fp", "<i8")])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text as an unsigned 64-bit number.

    A-Z lower-cased, words parted by ASCII white space, shingles of `shingle`
    words with repeats (fewer words: all of them as one), XXH64 with seed 42;
    a bit is set if more than half of the hashes have it. No words: 0.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))  # where the next word starts
    pieces = zip([0, *ends[:-shingle]], ends[shingle - 1 :], strict=True)
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in pieces), np.uint64, len(words) - shingle + 1)
    counts = np.zeros((8, 256), np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.bincount((hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): each document's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(x.as_py(), shingle)) for x in batch.column(1)]  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _mask(positions: tuple[int, ...], width: int) -> int:
    return sum(((1 << width) - 1) << (width * p) for p in positions)


def _masks() -> list[list[int]]:
    """Masks of the posting keys, by level; a mask's parent is at its index divided by the number of children.

    Level 0, 3 bytes: of 5 shared bytes 3 at least are in one half, and every
    triple of a half is a key. Level 1, 2 more of the 5 bytes that are left,
    of which 3 differ at most. Level 2, 3 of the 6 half bytes that are left,
    of which 3 differ at most.
    """
    first = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
    second = [(*t, *p) for t in first for p in combinations([b for b in range(8) if b not in t], 2)]
    third = [_mask(s, 8) | _mask(h, 4) for s in second for h in combinations([n for b in range(8) if b not in s for n in (2 * b, 2 * b + 1)], 3)]
    return [[_mask(t, 8) for t in first], [_mask(s, 8) for s in second], third]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node to the least of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != (up := root[root])).any():
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many postings (place, byte) two fingerprints have in common: what adding one for each list of the index they share comes to."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def counted(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places with equal keys whose fingerprints share `LEAST_BYTES` postings or more. keys: numbers of the lists, in order."""
    at, step = np.arange(len(fps)), 0
    while True:
        step += 1
        at = at[at + step < len(fps)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return
        near = at[tally(fps[at], fps[at + step]) >= LEAST_BYTES]
        yield near, near + step


def _links(keys: np.ndarray, fps: np.ndarray, most_edges: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one list, as a forest: counted, then verified on all bits."""
    a, b, held = [], [], 0
    for x, y in counted(keys, fps):
        near = np.bitwise_count((fps[x] ^ fps[y]).view(np.uint64)) <= MOST_BITS
        a.append(fps[x[near]])
        b.append(fps[y[near]])
        held += len(a[-1])
        if held > most_edges:
            x, y = _forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(a), np.concatenate(b))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within posting lists, which come in order and may go on in the next batch."""
    rest: tuple[np.ndarray, ...] | None = None
    done = False
    batches = iter(batches)
    while not done:
        batch = next(batches, None)
        done = batch is None
        new = tuple(np.empty(0, np.int64) for _ in range(3)) if done else tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        mask, part, fps = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new, strict=True))
        if not len(fps):
            rest = None
            continue
        keys = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (part[1:] != part[:-1]))])
        cut = len(fps) if done else int(np.searchsorted(keys, keys[-1]))
        rest = (mask[cut:], part[cut:], fps[cut:])
        a, b = _links(keys[:cut], fps[:cut])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(distinct: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """Edges (a, b) that join the fingerprints `fp` within three bits as all pairs would.

    A link's fingerprints share 5 of 8 postings (place, byte) at least. Lists of
    single postings would hold a 256th of the corpus each, so that tallies
    would grow with its square; here the postings of a half are met three at a
    time, 8 lists a fingerprint. Of 5 shared postings three are in one half, so
    that every pair that the count filter keeps meets in a list, and in a list
    a pair's count is taken over all 8 postings: the pairs with 5 or more are
    those of the index of single postings. They are verified on all bits, and a
    spanning forest of what is linked leaves the task. Lists of more than `longest` fingerprints are split by two more
    of the bytes, then by three half bytes, which again loses no link; then at
    most 4096 different fingerprints are left for a list.
    """
    levels = _masks()
    as_array = lambda level: F.array(*[F.lit(_signed(m)).cast("long") for m in levels[level]])
    keyed = distinct.select(F.posexplode(as_array(0)).alias("mask", "bits"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("part"), "fp")
    ready: DataFrame | None = None
    for level in range(len(levels)):
        hot = None
        if level + 1 < len(levels):
            hot = settle(keyed.groupBy("mask", "part").count().where(F.col("count") > longest).select("mask", "part", F.lit(True).alias("long_list")))
            if hot.isEmpty():
                hot = None
        if hot is None:
            ready = keyed.withColumn("level", F.lit(level)) if ready is None else ready.union(keyed.withColumn("level", F.lit(level)))
            break
        told = settle(keyed.join(hot, ["mask", "part"], "left"))
        kept = told.where("long_list is null").select("mask", "part", "fp", F.lit(level).alias("level"))
        ready = kept if ready is None else ready.union(kept)
        children = len(levels[level + 1]) // len(levels[level])
        keyed = (
            told.where("long_list")
            .select("fp", F.explode(F.sequence(F.col("mask") * children, F.col("mask") * children + (children - 1))).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.element_at(as_array(level + 1), F.col("mask") + 1)).alias("part"), "fp")
        )
    lists = ready.select((F.col("level") * 10_000 + F.col("mask")).cast("long").alias("mask"), "part", "fp")
    return lists.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(_match, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, longest: int = LONGEST_LIST) -> DataFrame:
    """(doc_id, fingerprint, component_id): each document's SimHash and the least id it reaches.

    Documents with equal fingerprints are one class; classes are linked by
    `links`, components found by star contractions, and each document gets its
    component's least id, its own included. fingerprint: 16 hex digits.

    Null, empty and white texts have fingerprint zero and are linked like any
    other; texts of any length are read whole; a fingerprint that very many rows
    have is joined by broadcast (`join_facts`); repeated rows stay, each with its
    component; null ids stay and are the component's id only if it has no other;
    an empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, shingle, longest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, longest: int) -> DataFrame:
    """(fp, doc_id, root, component_id) of each document; root: the least fingerprint of its component."""
    marked = settle(fingerprints(docs, id_col, text_col, shingle))
    classes = settle(marked.select("fp").distinct())
    return rooted(marked, components(links(classes, longest)))


def rooted(marked: DataFrame, stars: DataFrame) -> DataFrame:
    """`marked` (doc_id, fp) as (fp, doc_id, root, component_id); stars: (node, root) of the fingerprints that are linked."""
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    roots = settle(classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    parts = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fingerprints"))
    named = settle(join_facts(roots, parts, ["root"], "fingerprints").select("fp", "rows", "root", "component_id"))
    return join_facts(marked, named, ["fp"], "rows").select("fp", "doc_id", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, longest: int = LONGEST_LIST) -> DataFrame:
    """`docs`, all columns, with one document of each component of `near_duplicates`: that of the least id.

    Where rows share that id, or have none, one of them stays for each component.
    Null, empty and white texts are one component; texts of any length are read
    whole; an empty table gives no rows; other columns may have any names.
    """
    grouped = settle(_grouped(docs, id_col, text_col, shingle, longest))
    return keep_least(docs, grouped, id_col, text_col, lambda text: _signed(fingerprint(text, shingle)))


def keep_least(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str, key: Callable[[str | None], int]) -> DataFrame:
    """Of each component of `grouped`, as `rooted` has it, the document of the least id; key: the `fp` of a text."""
    by_id = grouped.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id"))
    own_name = "id" + "_" * max(map(len, docs.columns))  # no column of the documents
    alone = by_id.where("n = 1 and doc_id = component_id").select(F.col("doc_id").alias(own_name))
    kept = docs.join(alone, F.col(id_col) == F.col(own_name), "left_semi")
    shared = settle(by_id.where("n > 1 or doc_id is null").select("doc_id"))
    if shared.isEmpty():
        return kept
    # of these rows, the fingerprint says which component each is of
    at, names, kind = docs.columns.index(text_col), docs.columns, ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    own = names.index(id_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = pa.array([key(x.as_py()) for x in part.column(at)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*(f"c{i}" for i in range(len(names))), "fp"])

    rows = docs.join(shared.withColumnRenamed("doc_id", own_name), F.col(id_col).eqNullSafe(F.col(own_name)), "left_semi").mapInArrow(mark, f"{kind}, fp long")
    least = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "root").distinct()
    rows = rows.join(least, (F.col("fp") == F.col("_fp")) & F.col(f"c{own}").eqNullSafe(F.col("_id"))).dropDuplicates(["root"])
    return kept.union(rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names))))


def wide(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of hashes in 16 bits for each of `LISTS`: a bit is set if more than half of the hashes, mixed anew for each word, and of one vote that all sets share have it.

    Without that vote small sets of even size have many ties, which a set with
    one more element decides by that element.
    """
    counts = _VOTE.copy()
    for i in range(0, len(hashes), 255):  # counts of a byte
        x = hashes[i : i + 255, None] + _WORDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes) + 1).tobytes()


def entries(fp: np.ndarray, size: np.ndarray, bits: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """What goes into the lists of classes, but for the key: sizes up to 65,535, 128 bits of the fingerprint, and the sketch folded to 128 places."""
    rows = np.empty(len(fp), _ENTRY)
    rows["fp"], rows["size"] = fp, np.minimum(size, 0xFFFF)
    rows["bits"] = np.ascontiguousarray(bits[:, :16]).view("<u8")
    rows["odd"] = np.bitwise_xor.reduce(sketch.reshape(len(fp), -1, 16), axis=1).view("<u8")
    return rows


def _posted(batches: Iterator[pa.RecordBatch], leading: int) -> Iterator[pa.RecordBatch]:
    """(band, part, entries): the index of positional bytes of (fp, size, bits, sketch), what has the same `leading` bits of a list's key as one row."""
    for batch in (b for b in batches if b.num_rows):
        bits, sketch = (np.frombuffer(b"".join(x.as_py() for x in batch.column(i)), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        rows, keys = entries(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits, sketch), bits.view(">u2")
        for band in range(LISTS):
            rows["key"] = keys[:, band]
            dealt = rows[np.argsort(rows["key"], kind="stable")]
            part = dealt["key"] >> np.uint16(16 - leading)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = [dealt[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(dealt)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), band, np.int32)), pa.array(part[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["band", "part", "entries"])


def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs of entries may be of sets with a Jaccard similarity of 0.8.

    The fingerprints' distance tells it but for two pairs in ten million; the
    lesser set has 0.8 of the larger one's elements, and of both sets' elements
    a ninth at most, in so many folded places at most, aren't common: two
    bounds that are never wrong, for sizes that an entry can hold.
    """
    a, b = x["size"].astype(np.int64), y["size"].astype(np.int64)
    apart, odd = (np.bitwise_count(x[c] ^ y[c]).sum(axis=1, dtype=np.int64) for c in ("bits", "odd"))
    allowed = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * odd <= a + b)
    return (apart <= MOST_APART) & (allowed | (np.maximum(a, b) == 0xFFFF))


def alike(rows: np.ndarray, most_edges: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root): the entries that are `close` to another of the same key, and the least fp that they reach so."""
    rows = rows[np.lexsort((rows["size"], rows["key"]))]
    key, size, fp = np.ascontiguousarray(rows["key"]), rows["size"].astype(np.int64), np.ascontiguousarray(rows["fp"])
    words = [np.ascontiguousarray(rows["bits"][:, i]) for i in range(2)]
    a, b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    at, step = np.arange(len(rows)), 0
    while len(at):
        step += 1
        at = at[at + step < len(rows)]
        at = at[(key[at] == key[at + step]) & (5 * size[at] >= 4 * size[at + step])]  # sizes only grow from here on
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            some = some[sum(np.bitwise_count(w[some] ^ w[some + step]) for w in words) <= MOST_APART]
            some = some[close(rows[some], rows[some + step])]
            a.append(fp[some])
            b.append(fp[some + step])
            held += len(some)
            if held > most_edges:
                x, y = _forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
    node, root = _forest(np.concatenate(a), np.concatenate(b))
    tops = np.unique(root)
    return np.concatenate([node, tops]), np.concatenate([root, tops])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key, fp): the groups of entries that are `alike`; rows of one band and part come one after another."""

    def told(at: tuple[int, int], blobs: list[bytes]) -> pa.RecordBatch:
        fp, root = alike(np.frombuffer(b"".join(blobs), _ENTRY))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), at[0], np.int32)), pa.array(root), pa.array(fp)], ["band", "key", "fp"])

    was, blobs = (-1, -1), []
    for batch in batches:
        for band, part, entries in zip(*(batch.column(i) for i in range(3)), strict=True):
            at = (band.as_py(), part.as_py())
            if at != was and blobs:
                yield told(was, blobs)
                blobs = []
            was = at
            blobs.append(entries.as_py())
    if blobs:
        yield told(was, blobs)


def meeting(classes: DataFrame) -> DataFrame:
    """(band, key, fp): where the classes (fp, size, bits, sketch) of sets, bits as `wide` has them, meet others that may be at 0.8.

    The index of positional bytes again, for links as wide as a Jaccard
    similarity of 0.8, which no count of 8 bytes holds: fingerprints are
    longer, lists have two postings (place, byte) each, so that who is in one
    has at least that count, and what goes along in an entry says who is
    `close`. A list is parted into the groups that closeness makes, named by
    their least fp; who is close to none leaves nothing. sketch: the parities
    of the set's counts by place, of a multiple of 128 places. Entries, of 44
    bytes each, share rows.
    """
    leading = max(4, min(16, (classes.count() // ENTRIES).bit_length()))
    posted = classes.select("fp", "size", "bits", "sketch").mapInArrow(lambda batches: _posted(batches, leading), "band int, part int, entries binary")
    return posted.repartition("band", "part").sortWithinPartitions("band", "part").mapInArrow(_met, "band int, key long, fp long")
