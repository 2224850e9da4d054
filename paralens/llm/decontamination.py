"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns the training texts into segments of a few megabytes. A segment is one row: its
documents, its terms with their bytes, and for every term the sorted word positions at which it occurs.
Segments are partitioned by document, so no posting ever moves, a term that every document holds
costs no more than its own positions, and a lost executor only rebuilds segments. The stored index holds every
word and serves any benchmark. It is searched for windows of the test items: in every segment a window
starts from its rarest term's list, and the lists of its other terms, rarest first, are intersected
after subtracting their offsets in the window. Test items are a stated query set: they are read and sent to the
segments in blocks of bounded size, each searched and its matches stored before the next is read.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z and equal if their bytes are. Null texts have none;
items with a null id or no words match nothing; repeated documents are matched one by one; rows of one item id count as
one item; empty tables give empty or clean results. A text longer than a segment is a segment of its own.
Only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Table
from .ragged import LOWER, PLAIN_WORD, Hashes, Ranges, blocks, flat, identity, runs, spread

SEGMENT_BYTES = 1 << 20
#: MB of texts or segments that go to a Python worker at once.
BATCH_MB = 4
#: Windows sent to the executors at once, at most 8 bytes a word of them.
BLOCK_WINDOWS = 200_000
#: Candidate positions held at once while lists are intersected.
CANDIDATES = 1 << 20


@dataclass
class Queries:
    """A block of windows over the distinct words of its items."""

    items: list  # the id of each item
    terms: np.ndarray  # hashes of the distinct words
    chars: np.ndarray  # their bytes, one word after another
    ends: np.ndarray
    windows: np.ndarray  # a row a window: indexes into terms, -1 beyond its length
    item: np.ndarray  # which item each window is of


class Words:
    """The lowered words of a block of texts: where they stand, which texts they are of, and which are equal."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.lowered = LOWER[data]
        self.starts, ends, self.row = runs(PLAIN_WORD[self.lowered], offs)
        self.size = ends - self.starts
        hashes = Hashes(self.lowered)
        h = hashes.of(self.starts, ends)
        self.term, self.first = identity(hashes, h, self.starts, self.size)
        self.hash = h[self.first]

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the distinct words, and where each ends."""
        size = self.size[self.first]
        return self.lowered[spread(self.starts[self.first], size)], np.cumsum(size)


def query_block(items: list[tuple], size: int) -> Queries:
    """Windows of ``size`` words of (id, text) items; a shorter item is one window."""
    w = Words(*flat(pa.array([t for _, t in items], pa.string())))
    count = np.bincount(w.row, minlength=len(items))
    word0 = np.cumsum(count) - count
    n = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    item = np.repeat(np.arange(len(items)), n)
    at = spread(word0, n)[:, None] + np.arange(size)
    inside = np.arange(size) < np.minimum(count, size)[item][:, None]
    windows = np.where(inside, w.term[np.minimum(at, max(0, len(w.term) - 1))] if len(w.term) else -1, -1)
    return Queries([i for i, _ in items], w.hash, *w.chars(), windows.astype(np.int32), item)


def query_blocks(items: DataFrame, size: int, id_col: str, text_col: str, limit: int = BLOCK_WINDOWS) -> Iterator[Queries]:
    """The items in blocks of about ``limit`` windows, read one partition at a time."""
    held, words = [], 0
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("string"))
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        words += len(row[1]) // 2 + 1  # as many words as it can have
        if words >= limit:
            yield query_block(held, size)
            held, words = [], 0
    if held:
        yield query_block(held, size)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a segment, with the postings of all words."""
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    binary = ("n_words", "terms", "chars", "char_ends", "ends", "positions")
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ids", T.ArrayType(picked.schema[0].dataType)), *(T.StructField(c, T.BinaryType()) for c in binary)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch, data, offs in blocks(batches, "__text", SEGMENT_BYTES):
            w = Words(data, offs)
            # Terms are in the order of their hashes; of equal hashes but other bytes there can be several.
            order = np.argsort(w.hash, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            term = rank[w.term]
            size = w.size[w.first][order]
            arrays = [
                np.bincount(w.row, minlength=batch.num_rows).astype(np.int32), w.hash[order], w.lowered[spread(w.starts[w.first][order], size)], np.cumsum(size).astype(np.int32),
                np.cumsum(np.bincount(term, minlength=len(order))).astype(np.int32), np.argsort(term, kind="stable").astype(np.int32),
            ]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=names)
            number += 1

    return picked.mapInArrow(run, schema)


class Segment:
    """The postings of one index row."""

    def __init__(self, n_words: bytes, terms: bytes, chars: bytes, char_ends: bytes, ends: bytes, positions: bytes):
        self.n_words = np.frombuffer(n_words, np.int32).astype(np.int64)
        self.word0 = np.cumsum(self.n_words) - self.n_words
        self.terms = np.frombuffer(terms, np.uint64)
        self.chars = Ranges(np.frombuffer(chars, np.uint8))
        self.char_ends = np.frombuffer(char_ends, np.int32).astype(np.int64)
        self.ends = np.frombuffer(ends, np.int32).astype(np.int64)
        self.positions = np.frombuffer(positions, np.int32).astype(np.int64)
        self.counts = np.diff(self.ends, prepend=0)
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.positions

    def find(self, queries: Queries) -> np.ndarray:
        """The term here that each word of the queries is, or -2."""
        out = np.full(len(queries.terms), -2)
        size, mine = np.diff(queries.ends, prepend=0), np.diff(self.char_ends, prepend=0)
        starts, words = queries.ends - size, Ranges(queries.chars)
        at = np.searchsorted(self.terms, queries.terms)
        left = np.flatnonzero(at < len(self.terms))
        while len(left):  # once, unless other words have the same hash
            left = left[self.terms[at[left]] == queries.terms[left]]
            same = mine[at[left]] == size[left]
            same[same] = words.alike(starts[left[same]], size[left[same]], self.chars, (self.char_ends - mine)[at[left[same]]])
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(self.terms)]
        return out

    def _ready(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose words occur here: their numbers, terms and columns by rising frequency."""
        local = np.append(self.find(queries), -1)[queries.windows]
        rows = np.flatnonzero((local != -2).all(1) & (local[:, 0] >= 0)) if local.size else np.zeros(0, np.int64)
        local = local[rows]
        often = np.where(local >= 0, self.counts[local] if len(self.counts) else 0, np.iinfo(np.int64).max)
        return rows, local, np.argsort(often, axis=1, kind="stable")

    def _candidates(self, local: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window indexes and positions of their rarest terms, in bounded portions."""
        rarest = local[np.arange(len(local)), columns[:, 0]]
        n = self.counts[rarest]
        portion = (np.cumsum(n) - n) // CANDIDATES
        for p in np.unique(portion):
            w = np.flatnonzero(portion == p)
            yield np.repeat(w, n[w]), self.positions[spread((self.ends - self.counts)[rarest[w]], n[w])]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word0 + self.n_words, positions, "right")

    def phrases(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every exact occurrence: window, first position, position after the last."""
        rows, local, columns = self._ready(queries)
        lengths = (local >= 0).sum(1)
        found = []
        for w, at in self._candidates(local, columns):
            start = at - columns[w, 0]
            for k in range(1, local.shape[1]):
                column = columns[w, k]
                term = local[w, column]
                key = (np.maximum(term, 0) << 32) | np.maximum(start + column, 0)
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                keep = (term < 0) | ((self.keys[place] == key) & (start + column >= 0))
                w, start = w[keep], start[keep]
            end = start + lengths[w]
            keep = start >= 0
            w, start, end = w[keep], start[keep], end[keep]
            keep = self.doc_of(start) == self.doc_of(end - 1)
            found.append((rows[w[keep]], start[keep], end[keep]))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty, empty)

    def near(self, queries: Queries, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and positions of their rarest word where all their words occur, in any order, at most ``slop`` words from it in the same document."""
        rows, local, columns = self._ready(queries)
        found = []
        for w, at in self._candidates(local, columns):
            doc = self.doc_of(at)
            low, high = np.maximum(self.word0[doc], at - slop), np.minimum(self.word0[doc] + self.n_words[doc] - 1, at + slop)
            keep = np.ones(len(w), bool)
            for k in range(1, local.shape[1]):
                term = local[w, columns[w, k]]
                some = np.searchsorted(self.keys, (np.maximum(term, 0) << 32) | high, "right") > np.searchsorted(self.keys, (np.maximum(term, 0) << 32) | low)
                keep &= some | (term < 0)
            found.append((rows[w[keep]], at[keep]))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty)


def search(index: DataFrame, queries: Queries, slop: int | None = None) -> DataFrame:
    """One row a document: segment, place, id, n_words, spans (merged ranges of hit words, end exclusive) and items (ids of the rows of the benchmark that match).

    Exact phrases, or with ``slop`` proximity matches, whose spans are the anchors alone.
    """
    id_type = index.schema["ids"].dataType.elementType
    item_type = T.LongType() if all(isinstance(i, int) for i in queries.items) else T.StringType()
    item_ids = queries.items if isinstance(item_type, T.LongType) else [str(i) for i in queries.items]
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())]))
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("id", id_type),
        T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(item_type)),
    ])
    names = [f.name for f in schema]

    def listed(values: list[pa.Array], doc: np.ndarray, n: int) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        inner = values[0] if len(values) == 1 else pa.StructArray.from_arrays(values, names=["first", "after"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_item = pa.array(item_ids, pa.int64() if isinstance(item_type, T.LongType) else pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[k]  # noqa: E731, B023
                s = Segment(*(cell(c).as_buffer() for c in ("n_words", "terms", "chars", "char_ends", "ends", "positions")))
                n = len(s.n_words)
                if slop is None:
                    w, first, after = s.phrases(queries)
                else:
                    w, first = s.near(queries, slop)
                    after = first + 1
                doc = s.doc_of(first)
                order = np.lexsort((first, doc))
                d, f, a = doc[order], first[order] - s.word0[doc[order]], after[order] - s.word0[doc[order]]
                wide = d * (int(s.n_words.max(initial=0)) + 1)  # ranges of different documents never touch
                reach = np.maximum.accumulate(wide + a) if len(a) else a
                fresh = np.ones(len(d), bool)
                fresh[1:] = (wide + f)[1:] > reach[:-1]
                lead = np.flatnonzero(fresh)
                stop = reach[np.append(lead[1:], len(d))[: len(lead)] - 1] - wide[lead] if len(lead) else lead
                pairs = np.unique(np.stack([doc, queries.item[w]]), axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, cell("segment").as_py())), pa.array(np.arange(n), pa.int32()), cell("ids").values, pa.array(s.n_words),
                    listed([pa.array(f[lead], pa.int32()), pa.array(stop, pa.int32())], d[lead], n), listed([of_item.take(pa.array(pairs[1]))], pairs[0], n),
                ], names=names)

    return index.mapInArrow(run, schema)


def documents_of(index: DataFrame) -> DataFrame:
    """segment, place, id and n_words of every document of an index."""
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("id", id_type), T.StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, ids, n_words in zip(*batch.columns, strict=True):
                n = np.frombuffer(n_words.as_buffer(), np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), segment.as_py())), pa.array(np.arange(len(n)), pa.int32()), ids.values, pa.array(n)], names=[f.name for f in schema])

    return index.select("segment", "ids", "n_words").mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a document: id, n_words, n_hit, spans and items, after building, storing and searching the index."""
    index = Table(build_index(docs, id_col, text_col), "postings", group_mb=8, batch_mb=BATCH_MB, dictionary=False).df
    matches = []
    for block in query_blocks(items, window, item_id, item_text, block_windows):  # the driver holds one block at a time
        found = search(index, block).where(F.size("items") > 0).select("segment", "place", "spans", "items")
        matches.append(Table(found, "matches", batch_mb=BATCH_MB).df)
    every = documents_of(index)
    if not matches:
        matches = [search(index.limit(0), query_block([], window)).select("segment", "place", "spans", "items")]
    merged = reduce(DataFrame.unionByName, matches).groupBy("segment", "place").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    longer = F.aggregate(
        "spans", start,
        lambda s, x: F.struct(F.greatest(s["reach"], x["after"]).alias("reach"), (s["n"] + F.greatest(F.lit(0), x["after"] - F.greatest(s["reach"], x["first"]))).alias("n")),
        lambda s: s["n"],
    )
    spans, listed = (F.coalesce(c, F.array()).cast(merged.schema[c].dataType).alias(c) for c in ("spans", "items"))
    out = every.join(merged, ["segment", "place"], "left").select("id", "n_words", spans, listed)
    return out.select(F.col("id").alias(id_col), "n_words", longer.alias("n_hit"), "spans", "items")
