"""Documents of near-equal wording: five-word shingles with a Jaccard similarity of 0.8 or more, or SimHash links.

SimHash links of 4 bits miss most pairs at that similarity: their fingerprints differ in up to 14
of 64 bits, and no table of blocks of bits holds all links that wide. So buckets come from minima
of shingle hashes (BANDS keys of BAND_ROWS minima each: a pair of similarity 0.8 shares one with
probability 0.998), and whole shingle sets decide.

1. Texts with equal shingle sets are one class and cost one row.
2. In every bucket all classes are compared with the first one. That is a row a class, not a pair, and
   buckets mostly have the same first, so most of these rows are alike and compared once. What is linked
   is joined to components.
3. Only buckets in which several components are left compare the classes of different ones with each
   other, in parts of bounded size: every two parts of a bucket meet in one group.

So a group of near copies costs its size. Only bounds that hold for any two sets discard pairs: those on their
sizes, and on the shingles that just one of both has, which are no fewer than their counts by hash range
differ in all. A bucket of many classes that are no near copies of its first is still dealt in pairs of parts.

A text of fewer words is one shingle; texts without words are one class, null ones among them. Of a group the row of
the smallest id stays, rows without one last, and of equal ids that of the smallest digest of its text; ids need be
neither there nor unique. An empty table keeps nothing; other columns, of any name, come back as they are. Shingles are 64-bit hashes in
classes and buckets, and 32 bits of them in the comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Table, written
from .near_dedup import AT_ONCE, components, majority, near_classes, shingle_hashes, whole_buckets, with_classes
from .ragged import U64, blocks, mixed, spread

WORDS = 5
#: Similarity of links, as a fraction in whole numbers.
OVER, UNDER = 4, 5
BANDS, BAND_ROWS = 12, 4
#: Hash ranges by which shingles are counted: their first bits.
RANGE_BITS = 8
#: Shingles compared at once, and of one part of a bucket.
COMPARED, PART_SHINGLES = 1 << 20, 1 << 20
#: Column for what tells rows apart: whether the id is missing, the id, and a digest of the text. Rows without an id come last.
NAME = "__name"

SetsOf = Callable[[DataFrame], DataFrame]
Stored = Callable[[DataFrame, str], DataFrame]


def _profile(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Fingerprint of each text, whether it has words, and its bucket keys followed by two sums over its set of shingles and their number."""
    h, shingles = shingle_hashes(data, offs, WORDS)
    fp = majority(h, shingles)
    n, rows = len(offs) - 1, np.flatnonzero(shingles)
    if not len(rows):
        return fp, shingles > 0, [np.zeros(n, U64)] * (BANDS + 3)
    first = (np.cumsum(shingles) - shingles)[rows]
    columns = []
    for band in range(BANDS):
        key = np.full(len(rows), band, U64)
        for k in range(BAND_ROWS):
            turn = mixed(U64(band * BAND_ROWS + k + 1) * U64(0x9E3779B97F4A7C15)) | U64(1)
            v = h * turn
            v ^= v >> U64(32)
            key = mixed(key + np.minimum.reduceat(v, first))
        columns.append(key)
    of = np.repeat(np.arange(len(rows)), shingles[rows])
    order = np.lexsort((h, of))
    s, of = h[order], of[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])])
    for salt in (1, 2):
        columns.append(np.add.reduceat(np.where(new, mixed(s + U64(salt)), U64(0)), first))
    columns.append(np.add.reduceat(new.astype(U64), first))
    out = []
    for c in columns:
        every = np.zeros(n, U64)
        every[rows] = c
        out.append(every)
    return fp, shingles > 0, out


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fp`` (SimHash), ``s1`` and ``s2`` (equal if the sets of shingles are), ``n`` (shingles in the set), ``keys`` (buckets)."""
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    longs = [T.StructField(c, T.LongType()) for c in ("fp", "s1", "s2", "n")]
    schema = T.StructType([picked.schema[0], *longs, T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "__text", AT_ONCE):
            fp, some, columns = _profile(data, offs)
            keys = np.stack([c[some] for c in columns[:BANDS]], axis=1).ravel()
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.view(np.int64)) for c in (fp, *columns[BANDS:])), lists], names=[f.name for f in schema])

    return picked.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and ``shingles``: the sorted set of 32-bit hashes of the text's shingles."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "__text", AT_ONCE):
            h, shingles = shingle_hashes(data, offs, WORDS)
            of = np.repeat(np.arange(len(shingles), dtype=U64), shingles)
            held = np.unique((of << U64(32)) | (h >> U64(32)))
            ends = np.concatenate([[0], np.cumsum(np.bincount((held >> U64(32)).astype(np.int64), minlength=len(shingles)))]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(held.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "shingles"])

    return picked.mapInArrow(run, "id long, shingles array<int>")


def similar(component: np.ndarray, held: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest, as indices (a, b), of the similar pairs of different ``component`` among sorted sets ``held[offs[k] : offs[k + 1]]``.

    With a similarity of OVER / UNDER two sets have at most (UNDER - OVER) / (UNDER + OVER) of their shingles, counted
    in both, apart from each other; each of those changes one count.
    """
    size = np.diff(offs)
    where = np.repeat(np.arange(len(size)) << RANGE_BITS, size) + (held[offs[0] : offs[-1]] >> (32 - RANGE_BITS))
    counts = np.bincount(where, minlength=len(size) << RANGE_BITS).astype(np.int32).reshape(len(size), -1)
    left = np.argsort(size, kind="stable")
    a, b = [], []
    while len(left):
        with_first = component[left] == component[left[0]]
        queue, left = left[with_first].tolist(), left[~with_first]
        while queue and len(left):
            x = queue.pop()
            may = left[UNDER * np.minimum(size[left], size[x]) >= OVER * np.maximum(size[left], size[x])]
            apart = (UNDER - OVER) * (size[may] + size[x]) // (UNDER + OVER)
            may = may[np.abs(counts[may] - counts[x]).sum(axis=1) <= apart]
            own = held[offs[x] : offs[x + 1]]
            linked = np.zeros(len(may), bool)
            portion = np.cumsum(size[may]) // COMPARED
            for p in np.unique(portion):
                some = np.flatnonzero(portion == p)
                values = held[spread(offs[may[some]], size[may[some]])]
                at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                both = np.add.reduceat((own[at] == values).astype(np.int64), np.cumsum(size[may[some]]) - size[may[some]])
                linked[some] = UNDER * both >= OVER * (size[x] + size[may[some]] - both)
            found = may[linked]
            if len(found):
                one = found[np.unique(component[found], return_index=True)[1]]
                a.append(one)
                b.append(np.full(len(one), x))
                joined = np.isin(component[left], component[found])
                queue.extend(left[joined].tolist())
                left = left[~joined]
    return a, b


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


def first_links(rows: DataFrame, sets_of: SetsOf, stored: Stored) -> DataFrame:
    """(a, b): the similar pairs of every bucket's first class and another one. ``sets_of``: shingle sets of the nodes of a table."""
    first = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1")
    sized = (UNDER * F.least("n", "first.n") >= OVER * F.greatest("n", "first.n")) & (F.col("node") != F.col("first.node"))
    pairs = stored(rows.join(first, "bucket").where(sized).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = both.where(UNDER * shared >= OVER * (F.size("x") + F.size("y") - shared))
    return stored(linked.select("a", "b"), "first-links")


def other_links(rows: DataFrame, tree: DataFrame, sets_of: SetsOf, stored: Stored) -> DataFrame | None:
    """(a, b): a spanning forest, bucket by bucket, of the similar pairs of different components; None if there are no such buckets."""
    placed = rows.join(tree, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("component"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("weight")).where("low < high")
    parts = several.select("bucket", F.ceil(F.col("weight") / PART_SHINGLES).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.shiftleft(F.least(other, mine).cast("long"), 32) + F.greatest(other, mine))
    dealt = placed.join(parts, "bucket").select("bucket", "node", "n", "component", F.explode(meets).alias("pair"))
    order = ("bucket", "pair")

    def in_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with another component's in their group whose number of shingles allows the similarity."""
        for table in whole_buckets(batches):
            number = _runs_of(table)
            n, component = _numbers(table, "n", "component")
            by_size = np.lexsort((n, number))
            stays = np.zeros(len(n), bool)
            begin = np.flatnonzero(np.concatenate([[True], np.diff(number[by_size]) != 0]))
            for low, high in zip(begin, np.append(begin[1:], len(n)), strict=True):
                k = by_size[low:high]
                at_most = np.searchsorted(n[k], n[k] * UNDER // OVER, "right")
                at_least = np.searchsorted(n[k], -(-n[k] * OVER // UNDER), "left")
                # Runs of one component in the order of sizes: a range holds another one if it reaches beyond the row's own run.
                same = np.cumsum(np.concatenate([[0], component[k][1:] != component[k][:-1]]))
                stays[k] = (same[at_most - 1] != same) | (same[at_least] != same)
            yield from table.filter(pa.array(stays)).combine_chunks().to_batches()

    alive = stored(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(in_reach, dealt.schema), "buckets-in-reach")
    if not alive.limit(1).count():
        return None
    full = alive.join(sets_of(alive.select("node").distinct()), "node").select("bucket", "pair", "node", "component", "shingles").repartition(*order).sortWithinPartitions(*order)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            number = _runs_of(table)
            node, component = _numbers(table, "node", "component")
            begin = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for low, high in zip(begin[:-1], begin[1:], strict=True):
                lists = table["shingles"].slice(low, high - low).combine_chunks()
                held, offs = lists.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                for x, y in zip(*similar(component[low:high], held, offs), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(node[low + x]), pa.array(node[low + y])], names=["a", "b"])

    return full.mapInArrow(compared, "a long, b long")


def _runs_of(table: pa.Table) -> np.ndarray:
    """Number of the bucket part of each row."""
    bucket, pair = _numbers(table, "bucket", "pair")
    return np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of every group of documents that similarity or SimHash links join. ``docs`` is read three times."""
    made: list[Table] = []

    def stored(df: DataFrame, label: str) -> DataFrame:
        made.append(Table(df, label))
        return made[-1].df

    text = F.col(text_col).cast("string")
    name = F.struct(F.col(id_col).isNull().alias("lacks"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.md5(text), F.lit("")).alias("digest"))
    marked = stored(profiles(docs.select(name.alias(NAME), text.alias("__text")), NAME, "__text"), "profiles")
    shared = marked.groupBy("s1", "s2").agg(F.min(NAME).alias(NAME), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = stored(shared.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")  # stored, so that a class keeps its number
    # A row is of one class of equal sets and of one component of fingerprints, which is named by a class.
    prints = stored(marked.select("fp", "s1", "s2").distinct().join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("fp", "node"), "prints")
    found = near_classes(prints, "node")
    same = with_classes(prints, found).select(F.col("node").alias("a"), F.col("component_id").alias("b")).where("a <> b")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("node", NAME).join(nodes, "node", "left_semi")
        texts = docs.select(name.alias(NAME), text.alias("__text")).join(wanted, NAME).select("node", "__text")
        return stored(shingle_sets(texts, "node", "__text").withColumnRenamed("id", "node").dropDuplicates(["node"]), "shingle-sets")  # rows of one id and text give one set

    rows = stored(classes.select("node", "n", F.explode("keys").alias("bucket")), "buckets")
    tree = components(first_links(rows, sets_of, stored).unionAll(same))
    others = other_links(rows, tree, sets_of, stored)
    if others is not None:
        tree = components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(others))
    named = classes.select("node", NAME).join(tree, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(NAME).alias(NAME))
    kept = written(named.select(NAME), "kept")
    # Rows of one id and text but other columns: the first by these stays.
    several = marked.groupBy(NAME).agg(F.count(F.lit(1)).alias("times")).where("times > 1").join(kept, NAME, "left_semi").limit(1).count()
    for table in made:
        table.drop()
    out = docs.withColumn(NAME, name).join(kept, NAME, "left_semi")
    if several:
        mine = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        out = out.groupBy(NAME).agg(F.min_by(mine, F.to_json(mine)).alias("__row")).select("__row.*")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
