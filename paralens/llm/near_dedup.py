"""SimHash near-duplicates, found with pivot distance tables.

Every text gets a 64-bit fingerprint. Equal fingerprints are one class, so copies cost one row.
Two classes within ``radius`` bits agree on at least ``len(BLOCKS) - radius`` of the blocks below,
so each pair of blocks (of six, radius 4) is a table whose equal keys hold every link: nothing is
compared outside such a bucket. Within a bucket the distances of every fingerprint to PIVOTS
reference fingerprints are tabulated; by the triangle inequality a pair whose largest coordinate
difference exceeds the radius is discarded, and what survives is verified bit by bit. Pivots alone
would have to look at all pairs (one coordinate keeps 57 % of random pairs), hence the tables.

A bucket gives a spanning forest of its links, never all pairs. Buckets that a sample of the
fingerprints shows to be large are split into pairs of parts that different tasks compare. The
forests are joined by alternating large-star and small-star rounds, each written to the shared
folder, until nothing changes.

Null and empty texts have fingerprint zero and link like any other; null ids never name a
component unless it has no other; repeated rows share a class; an empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import LOWER, SPACED_WORD, U64, Ranges, blocks, runs, spread
from ..store import Table, written

BITS = 64
RADIUS = 4
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS = 16
XX_SEED = 42
#: Part of the fingerprints that show which buckets are large, and how many of a bucket's go to one part.
SHOWN, PART = 64, 2048
PAIRS_AT_ONCE = 1 << 21
#: Text bytes that are hashed at once.
AT_ONCE = 1 << 19
#: Fingerprints that more than this part of all rows share are sent to every executor: there are fewer than so many.
HOT = 10_000


#: The primes and rotations of XXH64, fixed values.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer ranges are hashed one by one.
LONG = 2048


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _lane(x: np.ndarray) -> np.ndarray:
    return _turned(x * P2, 31) * P1


def xxh64(ranges: Ranges, starts: np.ndarray, size: np.ndarray, seed: int = XX_SEED) -> np.ndarray:
    """XXH64 of ranges of a buffer, all of them a step at a time."""
    words = ranges.words
    out = np.full(len(starts), (seed + int(P5)) % (1 << 64), U64)
    at, left = starts.copy(), size.copy()
    whole = np.flatnonzero((size >= 32) & (size <= LONG))
    if len(whole):
        first = (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))
        lanes = [np.full(len(whole), x % (1 << 64), U64) for x in first]
        here = np.arange(len(whole))
        while len(here):
            place = at[whole[here]]
            for k, lane in enumerate(lanes):
                lane[here] = _turned(lane[here] + words[place + 8 * k] * P2, 31) * P1
            at[whole[here]] += 32
            left[whole[here]] -= 32
            here = here[left[whole[here]] >= 32]
        h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            h = (h ^ _lane(lane)) * P1 + P4
        out[whole] = h
    out += size.astype(U64)
    for _ in range(3):
        i = np.flatnonzero((left >= 8) & (size <= LONG))
        out[i] = _turned(out[i] ^ _lane(words[at[i]]), 27) * P1 + P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero((left >= 4) & (size <= LONG))
    out[i] = _turned(out[i] ^ ((words[at[i]] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero((left >= 1) & (size <= LONG))
        out[i] = _turned(out[i] ^ ((words[at[i]] & U64(0xFF)) * P5), 11) * P1
        at[i] += 1
        left[i] -= 1
    out ^= out >> U64(33)
    out *= P2
    out ^= out >> U64(29)
    out *= P3
    out ^= out >> U64(32)
    long = np.flatnonzero(size > LONG)  # few bytes a text hold few of these
    if len(long):
        from xxhash import xxh64_intdigest

        out[long] = [xxh64_intdigest(ranges.text(a, n), seed) for a, n in zip(starts[long].tolist(), size[long].tolist(), strict=True)]
    return out


def shingle_hashes(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word shingle, text by text, and the number of shingles of each text."""
    n = len(offs) - 1
    word = SPACED_WORD[data]
    starts, ends, row = runs(word, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    keep = word.copy()  # words and one space after each
    keep[1:] |= word[:-1]
    place = np.cumsum(keep) - 1
    text = Ranges(np.where(word, LOWER[data], 32)[keep].astype(np.uint8))
    first, last = place[starts], place[ends - 1] + 1
    count = np.bincount(row, minlength=n)
    word0 = np.cumsum(count) - count
    shingles = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    at = spread(word0, shingles)
    of = np.repeat(np.arange(n), shingles)
    end = np.minimum(at + size, (word0 + count)[of]) - 1
    return xxh64(text, first[at], last[end] - first[at]), shingles


def majority(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: bits set in over half its shingles' hashes."""
    out = np.zeros(len(shingles), np.uint64)
    rows = np.flatnonzero(shingles)
    if not len(rows):
        return out
    edge = np.cumsum(shingles[rows])
    ones = np.zeros((len(rows), BITS), np.int64)
    step = 1 << 17
    for low in range(0, len(h), step):
        bits = np.unpackbits(h[low : low + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(edge, low, "right"), np.searchsorted(edge, min(len(h), low + step), "left") + 1
        begin = np.maximum(np.concatenate([[0], edge[:-1]])[a:b] - low, 0)
        ones[a:b] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    major = (2 * ones > shingles[rows][:, None]).astype(np.uint8)
    out[rows] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp``: the SimHash of the lower-cased text's word shingles, repeats included, under XXH64 with seed 42."""
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([picked.schema[0], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "__text", AT_ONCE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(*shingle_hashes(data, offs, shingle)).view(np.int64))], names=[id_col, "fp"])

    return picked.mapInArrow(run, schema)


def pivots(n: int = PIVOTS, seed: int = XX_SEED) -> np.ndarray:
    """Reference fingerprints."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (column) to every reference (row)."""
    return np.bitwise_count(fps[None, :] ^ refs[:, None]).astype(np.int8)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def trees(bucket: np.ndarray, fps: np.ndarray, radius: int, refs: np.ndarray, equal: bool = False) -> np.ndarray:
    """For each fingerprint the index of the root of its tree in a forest of the links within buckets of equal number; ``equal`` ones link too if asked."""
    table = pivot_table(fps, refs)
    order = np.lexsort((table[0], bucket))
    bucket, fps, table = bucket[order], fps[order], table[:, order]
    number = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
    along = number * 256 + table[0]
    n = np.searchsorted(along, along + radius, "right") - np.arange(len(along)) - 1  # partners after each row
    tree = np.arange(len(fps))
    portion = np.cumsum(n) // PAIRS_AT_ONCE
    for p in np.unique(portion[n > 0]):
        x = np.flatnonzero((portion == p) & (n > 0))
        i, j = np.repeat(x, n[x]), spread(x + 1, n[x])
        for row in table[1:]:
            near = np.abs(row[i] - row[j]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        if not equal:
            near &= fps[i] != fps[j]
        i, j = i[near], j[near]
        up = np.flatnonzero(tree != np.arange(len(tree)))
        tree = roots(len(fps), np.concatenate([i, up]), np.concatenate([j, tree[up]]))
    out = np.empty_like(order)
    out[order] = order[tree]
    return out


def linked(bucket: np.ndarray, fps: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, another of its component), of the links within buckets of equal number."""
    tree = trees(bucket, fps, radius, refs)
    child = np.flatnonzero(tree != np.arange(len(tree)))
    return fps[child], fps[tree[child]]


def _part(col: str, first: int, width: int):
    return F.shiftrightunsigned(F.col(col), first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def split_buckets(classes: DataFrame, keys: Column, carry: tuple[str, ...]) -> DataFrame:
    """``carry``, bucket, pair: a row a key of ``keys``. A bucket that a sample shows to be large is dealt to every pair of its parts, so any two rows of it meet."""
    rows = classes.select(*carry, F.explode(keys).alias("bucket"))
    shown = classes.where(F.pmod(F.xxhash64(carry[0]), F.lit(SHOWN)) == 0).select(F.explode(keys).alias("bucket"))
    large = shown.groupBy("bucket").agg((F.count(F.lit(1)) * SHOWN).alias("n")).where(F.col("n") > 2 * PART)
    large = written(large.select("bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "large-buckets")
    if not large.limit(1).count():
        return rows.withColumn("pair", F.lit(0).cast("long"))
    mine = F.pmod(F.xxhash64(carry[0], F.lit(1)), F.col("parts")).cast("int")
    few = large.limit(100_001).count() <= 100_000
    return rows.join(F.broadcast(large) if few else large, "bucket", "left").select(
        *carry, "bucket", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.shiftleft(F.least(other, mine).cast("long"), 32) + F.greatest(other, mine)))).alias("pair"),
    )


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a partition as tables that end where a part of a bucket does."""
    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        bucket, pair = held["bucket"].to_numpy(), held["pair"].to_numpy()
        change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1]))
        if len(change):  # the last bucket may go on in the next batch
            yield held.slice(0, int(change[-1]) + 1)
            held = held.slice(int(change[-1]) + 1)
    if held is not None and held.num_rows:
        yield held


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of all pairs of distinct fingerprints ``fp`` within ``radius`` bits."""
    if len(BLOCKS) - radius != 2:
        raise ValueError("the tables are made for a radius of 4 bits")
    keys = []
    for k, (x, y) in enumerate(combinations(BLOCKS, 2)):
        keys.append(F.lit(k << 23).cast("long") + F.shiftleft(_part("fp", *x), y[1]) + _part("fp", *y))
    dealt = split_buckets(classes, F.array(*keys), ("fp",)).repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for table in whole_buckets(batches):
            bucket, pair, fp = (table[c].to_numpy() for c in ("bucket", "pair", "fp"))
            number = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])]))
            several = np.bincount(number)[number] > 1
            a, b = linked(number[several], fp[several].view(np.uint64), radius, refs)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node that each node with a link reaches."""
    now = Table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = now.df.select("u", "v").unionAll(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        new = Table(stars, "stars")
        mark = [F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))]
        done = tuple(new.df.agg(*mark).first()) == tuple(now.df.agg(*mark).first())
        now.drop()
        now = new
        if done:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def near_classes(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``fp``, ``n`` (rows) and ``component_id`` of each distinct fingerprint of ``marked``."""
    classes = written(marked.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    tree = components(links(classes))
    rooted = classes.join(tree, classes["fp"] == tree["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return written(rooted.join(named, "root").select("fp", "n", "component_id"), "components")


def with_classes(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``marked`` with their fingerprint's ``component_id``. A fingerprint of very many rows is never one task's: such ones are few and broadcast."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(classes.where(F.col("n") * HOT > F.lit(total)).select("fp", "component_id"))  # fewer than HOT rows
    cold = classes.where(F.col("n") * HOT <= F.lit(total)).select("fp", "component_id")
    return marked.join(hot, "fp").unionByName(marked.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``fp`` and ``component_id``, the smallest id that it reaches over links of at most 4 differing bits."""
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return with_classes(marked, near_classes(marked, id_col)).select(F.col(id_col), "fp", "component_id")
