"""N-gram Jaccard join by parity sketches.

A set's parity sketch has as many words of bits as fit its size; each shingle flips one
bit. Two sketches differ in at most as many bits as the sets differ in shingles, so
sets that are similar enough differ in so few bits that one of (that many + 1) words
must be equal: documents meet on such words, and what meets is verified on the sets.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, cut, discard, mix64, release, scratch_path

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes that are hashed at once: what the power tables hold for good, however long a text is.
SEGMENT = 1 << 18
#: Ids of different sets that may be broadcast (8 bytes each) to pick those sets' keys; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Size bands grow by this factor.
BAND = 1.5


@functools.cache
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, below n."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words raw[start:stop], a segment of the text at a time."""
    up, down = _power_tables(SEGMENT + 1)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(stop, base + SEGMENT, "right"))
        if j > i:  # words that lie in this segment as a whole
            part = raw[base : stop[j - 1]]
            run = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
            out[i:j] = (run[stop[i:j] - base] - run[start[i:j] - base]) * down[start[i:j] - base]
            i = j
            continue
        total, scale = np.uint64(0), np.uint64(1)  # one word longer than a segment
        for a in range(base, stop[i], SEGMENT):
            part = raw[a : min(a + SEGMENT, stop[i])]
            total += ((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]).sum(dtype=np.uint64) * scale
            scale *= up[SEGMENT]
        out[i] = total
        i += 1
    return out


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; vectorised over the whole text.

    Words are runs of anything but space, tab, LF, VT, FF, CR; A-Z count as a-z. With
    fewer words than width the whole sequence is one shingle; without words there is none.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    raw = _LOWER[raw]
    inside = np.concatenate([[False], ~_IS_WHITE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        words = mix64(_word_hashes(raw, start, stop) + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    k = min(width, len(words))
    seed = np.uint64(k)
    out = np.full(len(words) - k + 1, seed, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : len(words) - k + 1 + i])
    return np.unique(out)


def band_of(n: np.ndarray | int):
    """Size band of a set of n shingles."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


@functools.cache
def band_sizes(band: int) -> tuple[int, int]:
    """Least and most shingles of a band."""
    sizes = np.arange(max(1, int(BAND**band) - 2), int(BAND ** (band + 1)) + 3)
    own = sizes[band_of(sizes) == band]
    return (int(own[0]), int(own[-1])) if len(own) else (0, 0)


@functools.cache
def sketch_shape(band: int, num: int, den: int) -> tuple[int, int]:
    """(words, spare) of the sketches for pairs whose smaller side lies in a band.

    With similarity num/den or more, the larger set has at most hi * den / num shingles and
    the sets differ in at most (a + b) * (den - num) / (den + num). So many words may
    differ; one more and `spare` are equal, spare being more than the words that are
    expected to be empty.
    """
    lo, hi = band_sizes(band)
    differ = (hi + hi * den // num) * (den - num) // (den + num)
    spare = 1
    while True:  # empty words of a set of lo shingles: their mean and four deviations
        empty = (differ + 1 + spare) * math.exp(-lo / (differ + 1 + spare))
        if spare >= min(differ + 1, empty + 4 * math.sqrt(empty)):
            return differ + 1 + spare, spare
        spare += 1


def sketch_words(h: np.ndarray, band: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a set's parity sketch that have odd bits: (places, words).

    The sketch has 2^31 bits a word. A shingle flips the bit that its hash names, so equal
    shingles of two sets leave no difference. A word is written as the exclusive or of its
    odd bits' hashes: bits flipped twice cancel out in it as they do in the sketch.
    """
    words = sketch_shape(band, num, den)[0]
    place = ((h >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)  # rises with h, which is sorted
    flip = mix64((place << np.uint64(31)) | (h & np.uint64(0x7FFFFFFF)))
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    word = np.bitwise_xor.reduceat(flip, start)
    odd = word != 0
    return place[start][odd], word[odd]


#: Bits of the one-size sketch that pairs are held against before their texts are. Larger sets have a wide one besides.
FOLD = 1024
#: Shares of the keys that are shuffled one after another, so that only one of them lies on disk at a time.
SLICES = 8
#: Documents of a block of a leftover group: larger groups are dealt as pairs of blocks. Rows of one comparison.
GROUP, ROWS = 4_096, 64
#: A centre of more pairs than this, and than this share of them all, is given out so many times; at most 1 / HOT_SHARE can be.
STAR, HOT_SHARE = 2_000, 1 / 20_000
#: Sets from which on keys go in slices, and files that nothing needs any more are freed between the steps.
LARGE = 20_000


def pair_words(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set: its sketch words, each mixed with its place and band.

    A set meets others as the smaller or equal side in its own band, and as the larger side
    in each band that reaches up to it. Two similar sets have more equal words than spare.
    Empty words would make strangers meet, so they are no keys, but for a set with more
    empty words than spare: such sets meet each other on those too. All others have an
    equal word that is not empty.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    own, out = int(band_of(n)), []
    for band in {own, *range(int(band_of(max(1, -(-n * num // den)))), own)}:
        if band_sizes(band)[1]:
            words, spare = sketch_shape(band, num, den)
            place, word = sketch_words(h, band, num, den)
            if words - len(word) > spare:
                full = np.zeros(words, np.uint64)
                full[place] = word
                place, word = np.arange(words, dtype=np.uint64), full
            with np.errstate(over="ignore"):
                out.append(mix64(mix64(word) + place * np.uint64(0x9FB21C651E98DF25) + np.uint64(band + 1) * np.uint64(0xA24BAED4963EE407)))
    return np.concatenate(out).view(np.int64)


def fold_of(h: np.ndarray, bits: int) -> bytes:
    """The parity sketch of one word of so many bits, a power of two. Two of them differ in at most as many bits as the sets in shingles."""
    return np.packbits((np.bincount(((h >> np.uint64(16)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold_bits(n: int) -> int:
    """Bits of the wide sketch of a set of n shingles: as many as these, to the next power of two."""
    return 1 << max(3, (n - 1).bit_length())


#: Of each text: the sketch of FOLD bits, the wide one if that has more, and the keys by slice.
SETS = "doc_id long, n int, digest binary, fold binary, wide binary, " + ", ".join(f"k{i} array<long>" for i in range(SLICES))


def _sets(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, folds, wides, keys = [], [], [], [], [np.zeros(0, np.int64)]
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, width)
                sizes.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                folds.append(fold_of(h, FOLD))
                wides.append(fold_of(h, bits) if (bits := fold_bits(len(h))) > FOLD else None)
                keys.append(pair_words(h, num, den))
            cols = [b.column("doc_id"), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in (digests, folds, wides)), *_sliced(keys[1:], np.concatenate(keys))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "digest", "fold", "wide", *(f"k{i}" for i in range(SLICES))])

    return run


def _sliced(keys: list[np.ndarray], flat: np.ndarray) -> list[pa.ListArray]:
    """The rows' keys, which flat holds one after another, as a column a slice. A key's highest bits name its slice."""
    place = ((flat.view(np.uint64) >> np.uint64(32)) * np.uint64(SLICES) >> np.uint64(32)).astype(np.int64) * len(keys) + np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = flat[np.argsort(place, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=SLICES * len(keys)))])
    cuts = [ends[i * len(keys) : (i + 1) * len(keys) + 1] for i in range(SLICES)]
    return [pa.ListArray.from_arrays(pa.array(c - c[0], pa.int32()), pa.array(flat[c[0] : c[-1]])) for c in cuts]


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the larger one is folded to the other's size first, as parity sketches can be."""
    x, y = (np.frombuffer(z, np.uint8) for z in (x, y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _possible(num: int, den: int):
    """Keep the pairs whose sizes and sketches allow a link; no link is lost, as sketches never differ in more than the sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, other = (b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            fold, fold_other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, FOLD // 64) for c in ("fold_a", "fold_b"))
            most = (n + other) * (den - num)
            ok = (num * np.maximum(n, other) <= den * np.minimum(n, other)) & (np.bitwise_count(fold ^ fold_other).sum(axis=1, dtype=np.int64) * (den + num) <= most)
            for i in np.flatnonzero(ok):
                x, y = b.column("wide_a")[i].as_py(), b.column("wide_b")[i].as_py()
                ok[i] = x is None or y is None or _differ(x, y) * (den + num) <= most[i]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


def _near(num: int, den: int):
    """From rows sorted by key and block: the pairs of a key's documents that lie in different components and whose sketches allow a link.

    A block pair holds the documents of one block, or those of two, of which the first has side 0.
    """

    def group(side: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rows, cols = (np.arange(len(ids)), np.arange(len(ids))) if not side.any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        own = len(rows) == len(ids)
        for i in range(0, len(rows), ROWS):
            r = rows[i : i + ROWS]
            c = cols[i:] if own else cols
            differ = np.bitwise_count(fold[r, None, :] ^ fold[None, c, :]).sum(axis=2, dtype=np.int64)
            both = n[r, None] + n[None, c]
            least = np.minimum(n[r, None], n[None, c])  # sizes alone rule out pairs that are too unequal
            ok = (num * (both - least) <= den * least) & (differ * (den + num) <= both * (den - num)) & (comp[r, None] != comp[None, c]) & (ids[r, None] != ids[None, c])
            if own:
                ok &= r[:, None] < c[None, :]
            x, y = np.nonzero(ok)
            left.append(ids[r[x]])
            right.append(ids[c[y]])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _with_end(batches):
            if b is not None:
                cols = [*(b.column(c).to_numpy() for c in ("key", "i", "j", "side", "doc_id", "component")), b.column("n").to_numpy().astype(np.int64), np.frombuffer(b"".join(b.column("fold").to_pylist()), np.uint64).reshape(-1, FOLD // 64)]
                rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            change = np.zeros(len(rest[0]) - 1, bool)
            for c in rest[:3]:
                change |= c[1:] != c[:-1]
            edge = np.flatnonzero(np.concatenate([[True], change]))
            stop = np.append(edge[1:], len(rest[0]))
            whole = len(edge) if b is None else len(edge) - 1  # the last group may go on in the next batch
            out = [group(*(c[i:j] for c in rest[3:])) for i, j in zip(edge[:whole], stop[:whole], strict=True) if j - i > 1]
            rest = None if b is None else [c[edge[-1] :] for c in rest]
            if out:
                x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _verify(width: int, num: int, den: int):
    """Keep the pairs whose sets are similar enough. A centre's set is made once for a run of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, h0 = None, None
        for b in batches:
            a, z = [], []
            for i, x, j, y in zip(*(b.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b")), strict=True):
                if (i, x) != known:
                    known, h0 = (i, x), shingle_hashes(x, width)
                h1 = shingle_hashes(y, width)
                both = len(np.intersect1d(h0, h1, assume_unique=True))
                if den * both >= num * (len(h0) + len(h1) - both):
                    a.append(i)
                    z.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return run


def parity_join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have den * |A and B| >= num * |A or B|.

    Returns (id_col, n_shingles, component_id): the size of the set, and the smallest id
    reachable by links, the document itself included.

    Documents with equal sets meet first, by digest, so copies go on as one. Sketch words
    that several sets share then propose pairs, in three steps that lose no link between
    different components, whatever the group sizes:

    1. Stars: each document is held against the centre of its groups that shares most with
       others. A group of near copies costs about one verification a member.
    2. Stars once more, among the documents that no link has reached.
    3. All pairs of a group whose sides are still in different components. They are first
       held against each other by sketches, inside the group's task, and only those pairs
       leave it whose Hamming distance allows a link.

    Every pair is held against its sizes and its sketches, the wide ones included, which
    loses no link; what they allow is verified on the sets of the whole texts, for which
    docs is read again. So texts that only share a passage are not shuffled. Keys are
    shuffled in slices, one after another. What a key's group compares is
    dealt in pairs of bounded blocks, and a centre of many pairs is given out many times,
    so no group meets in one task.

    Null or empty texts, and texts of white space, have an empty set and link with
    nothing. Rows with a null id come back with a null component. Rows that repeat an id
    are one document: it links wherever one of its texts does, and each row has the size of
    its own set. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path, folds_path, met_path = (scratch_path(spark, name) for name in ("sets", "folds", "met"))
    rows.mapInArrow(_sets(width, num, den), SETS).write.parquet(path)
    made = spark.read.schema(SETS).parquet(path)
    full = made.where("n > 0 and doc_id is not null")
    sets = cut(made.select("doc_id", "n", "digest"))
    heads = cut(sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("head")))
    total = heads.count()
    tidy = release if total >= LARGE else (lambda spark: None)
    # the texts of a repeated id belong together, whatever they are
    again = cut(sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    repeats = not again.isEmpty()
    same = sets.join(again, "doc_id", "left_semi").join(heads, "digest").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()
    full.select("doc_id", "n", "fold", "wide").write.parquet(folds_path)
    folds = spark.read.schema("doc_id long, n int, fold binary, wide binary").parquet(folds_path)
    # the keys of one id of each set: whichever is fewer, these ids or the others, picks them
    ids = heads.select(F.col("head").alias("doc_id"))
    others = cut(sets.where("n > 0 and doc_id is not null").select("doc_id").join(ids, "doc_id", "left_anti").distinct())
    if others.count() <= BROADCAST_IDS:
        full = full.join(F.broadcast(others), "doc_id", "left_anti")
    else:
        full = full.join(F.broadcast(ids) if total <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    keys = [f"k{i}" for i in range(SLICES)]
    for part in [[k] for k in keys] if total >= LARGE else [keys]:
        words = full.select("doc_id", F.explode(F.concat(*part)).alias("key"))
        shared = cut(words.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
        words.join(shared, "key").select("key", "doc_id", "c").write.mode("append").parquet(met_path)
        del words, shared
        tidy(spark)
    del made, full, ids, others
    discard(spark, path)
    met = spark.read.schema("key long, doc_id long, c long").parquet(met_path)
    ids = cut(met.groupBy("doc_id").agg(F.sum("c").alias("weight")))
    met = cut(met.select("key", "doc_id").join(ids, "doc_id"))
    discard(spark, met_path)
    tidy(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, folds, rows, repeats, width, num, den, tidy)

    links = verified(_stars(met))
    comp = _components_of(ids, links)
    alone = comp.where("doc_id = component").join(links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).distinct(), "doc_id", "left_anti")
    single = met.join(alone.select("doc_id"), "doc_id", "left_semi")
    links = cut(links.unionByName(verified(_stars(single))))
    tidy(spark)
    comp = _components_of(ids, links)
    placed = met.select("key", "doc_id").join(comp, "doc_id")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("lo <> hi").select("key", "parts")
    left = cut(placed.join(mixed, "key"))
    block, other = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = left.withColumn("block", block).withColumn("other", other).select("key", "doc_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    pairs = dealt.join(folds.drop("wide"), "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(_near(num, den), "a long, b long").distinct()
    links = links.unionByName(verified(pairs))
    links = cut(links.unionByName(same) if repeats else links)  # nothing reads the sketches after this

    del pairs, folds, left, mixed, placed, comp, single, alone, dealt, met
    discard(spark, folds_path)
    tidy(spark)
    whole = components(links)
    head_of = heads.join(whole.select(F.col("id").alias("head"), "component"), "head", "left").select("digest", F.coalesce("component", "head").alias("component"))
    out = sets.join(head_of, "digest", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def _stars(met: DataFrame) -> DataFrame:
    """One pair a document, at most: the document and the weightiest centre of its groups."""
    centres = met.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("c"))
    best = met.join(centres, "key").where("doc_id <> -c.minus").groupBy("doc_id").agg(F.max("c").alias("c"))
    return best.select((-F.col("c.minus")).alias("a"), F.col("doc_id").alias("b"))


def _components_of(ids: DataFrame, links: DataFrame) -> DataFrame:
    return cut(ids.select("doc_id").join(components(links), F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")))


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs with the table's columns of both sides, as a, c_a, b and c_b. The rows of a centre follow each other."""
    n = pairs.count()
    few, hot = n <= BROADCAST_IDS, None
    if n > STAR:  # with fewer pairs no centre can have so many
        hot = pairs.groupBy("a").agg(F.count("*").alias("c")).where((F.col("c") > STAR) & (F.col("c") > n * HOT_SHARE))
        hot = cut(hot.select("a", F.ceil(F.col("c") / STAR).cast("int").alias("times")))

    def salted(df: DataFrame) -> DataFrame:
        times = df.join(F.broadcast(hot), "a", "left") if hot is not None else df.withColumn("times", F.lit(1))
        return times.withColumn("times", F.coalesce("times", F.lit(1)))

    def named(side: str) -> DataFrame:
        """The table's rows of the pairs' one side. Without a broadcast both sides share the table's shuffle by id."""
        own = pairs.select(F.col(side).alias("doc_id")).distinct()
        kept = table.join(F.broadcast(own) if few else own, "doc_id", "left_semi")
        return kept.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in table.columns if c != "doc_id"))

    left = salted(named("a")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
    dealt = salted(pairs).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("times")).cast("int")).drop("times")
    return dealt.join(named("b"), "b").join(left, ["a", "salt"]).drop("salt")


def _verified(pairs: DataFrame, folds: DataFrame, rows: DataFrame, repeats: bool, width: int, num: int, den: int, tidy: Callable) -> DataFrame:
    """The pairs that are links. Only the texts of pairs that their sketches allow are read, and lie in the shared folder meanwhile."""
    spark, pairs = pairs.sparkSession, cut(pairs)
    tidy(spark)
    pairs = cut(_beside(pairs, folds).mapInArrow(_possible(num, den), "a long, b long").distinct())
    tidy(spark)
    own = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = rows.join(F.broadcast(own) if own.count() <= BROADCAST_IDS else own, "doc_id", "left_semi")
    path = scratch_path(spark, "texts")
    (texts.dropDuplicates(["doc_id", "text"]) if repeats else texts).write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema("doc_id long, text string").parquet(path)
    found = cut(_beside(pairs, texts).mapInArrow(_verify(width, num, den), "a long, b long"))
    del pairs, own, texts
    discard(spark, path)
    tidy(spark)
    return found.distinct()


def keep_one(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The documents that stand for their component, and those without an id."""
    own = F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    gone = cut(joined.where("doc_id is not null").groupBy("doc_id").agg(own.alias("head")).where("not head").select("doc_id"))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def brute_force(texts: dict[int, str | None], width: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """(n_shingles, component_id) by comparing all pairs; for small fixtures."""
    sets = {}
    for d, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    root = {d: d for d in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


