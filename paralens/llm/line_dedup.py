"""Removal of repeated blocks of lines, cut where their content says.

A rolling hash over the hashes of WINDOW lines ends a chunk after a line whenever it is divisible by
DIVISOR, so boundaries depend on nearby lines alone: lines inserted before a passage shift it
without changing its chunks. A repeat seldom begins and ends at a chunk's edge, so the pairs of
neighbouring lines are matched beside the chunks and carry the match line by line to its ends.
Blocks, which are those pairs and the chunks of more lines, that hold a word and stand more than
once in the corpus are compared byte by byte, and all occurrences but the first (smallest id, then
place) are removed. So every repeat of two lines or more goes, whatever stands around it, if each
two lines of it hold a word. Occurrences may overlap: a run of equal lines keeps one. The first of
equal lines is never removed.

Texts are packed into bucketed groups that never move. A group emits a row for each distinct block of
its own, by two hashes of 64 and 32 bits; their sums say what stands more than once and where first. The group of the first
occurrence hands out the bytes, and every other group that has such a block gets them once and compares its own. A block
that every document holds is thus one row a group, in shuffled joins whose skewed partitions Spark splits.

Null texts are one empty line; null ids come after all others; rows of one id count as one
document, so a block at the same place of both stays in both; an empty table gives an empty result. Blocks of equal hashes
but other bytes than the first's stay.
Ids are integers; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import MAX_BUCKETS, Table
from .ragged import BASE, SPACED_WORD, U64, Hashes, Ranges, blocks, covered, flat, lines, mixed

GROUP_BYTES = 4 << 20
WINDOW, DIVISOR = 2, 3
LAST = np.iinfo(np.int64).max


class Lines(Ranges):
    """The texts of one group, cut into chunks of lines, and the blocks of them that are matched."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, sizes: np.ndarray):
        super().__init__(data)
        self.ids, self.data = ids, data
        self.offs = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.starts, self.ends, self.row = lines(data, self.offs)
        hashes = Hashes(data)
        h = hashes.of(self.starts, self.ends)
        roll = h.copy()
        for k in range(1, WINDOW):
            roll = roll * U64(BASE)
            roll[k:] += np.where(self.row[k:] == self.row[: len(h) - k], h[: len(h) - k], U64(0))
        cut = mixed(roll) % U64(DIVISOR) == 0
        new = np.ones(len(h), bool)
        new[1:] = cut[:-1] | (self.row[1:] != self.row[:-1])
        self.chunk_first = np.flatnonzero(new)
        chunk_last = np.append(self.chunk_first[1:], len(h))[: len(self.chunk_first)] - 1
        total = np.zeros(len(data) + 1, np.int32)  # a cell has less than 2 GB
        np.cumsum(SPACED_WORD[data], dtype=np.int32, out=total[1:])
        pair, long = np.flatnonzero(self.row[:-1] == self.row[1:]), np.flatnonzero(chunk_last > self.chunk_first + 1)
        first, last = np.concatenate([pair, self.chunk_first[long]]), np.concatenate([pair + 1, chunk_last[long]])
        picked = np.flatnonzero(total[self.ends[last]] > total[self.starts[first]])
        picked = picked[np.argsort(first[picked], kind="stable")]
        self.first, self.last = first[picked], last[picked]
        self.begin, self.stop, self.doc = self.starts[self.first], self.ends[self.last], self.row[self.first]
        self.size = self.stop - self.begin
        self.one, self.two = hashes.of(self.begin, self.stop).view(np.int64), Hashes(data, 1).of(self.begin, self.stop).astype(np.uint32)

    def place(self) -> np.ndarray:
        """Where in its text each block stands."""
        return self.begin - self.offs[self.doc]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first occurrence, by id and place, of each distinct block, and how often it occurs."""
        order = np.lexsort((self.place(), self.ids[self.doc], self.two, self.one))
        a, b = self.one[order], self.two[order]
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return order[heads], np.diff(np.append(heads, len(order)))

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which of the distinct (one, two) each block is, or -1."""
        order = np.lexsort((two, one))
        out, at = np.full(len(self.one), -1), np.searchsorted(one[order], self.one)
        left = np.flatnonzero(at < len(order))
        while len(left):  # once, unless blocks share the first hash alone
            left = left[one[order[at[left]]] == self.one[left]]
            same = two[order[at[left]]] == self.two[left]
            out[left[same]] = order[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(order)]
        return out

    def without(self, gone: np.ndarray) -> list[bytes]:
        """The texts without the lines ``gone``, the others joined by line feeds."""
        last = np.zeros(len(gone), bool)  # lines that no feed follows
        last[np.append(np.flatnonzero(self.row[1:] != self.row[:-1]), len(gone) - 1) if len(gone) else []] = True
        kept = np.flatnonzero(~gone)
        final = np.append(np.flatnonzero(self.row[kept][1:] != self.row[kept][:-1]), len(kept) - 1) if len(kept) else kept
        ends = self.ends[kept] + ~last[kept]
        ends[final] = self.ends[kept][final]
        starts = self.starts[kept]
        full = np.flatnonzero(ends > starts)  # no two begin or end at one place
        step = np.zeros(len(self.data) + 1, np.int8)
        step[starts[full]] = 1
        step[ends[full]] -= 1
        raw = self.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)].tobytes()
        edge = np.concatenate([[0], np.cumsum(np.bincount(self.row[kept], weights=ends - starts, minlength=len(self.ids)).astype(np.int64))])
        return [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    names = ["part", "ids", "data", "sizes"]
    kinds = [T.LongType(), T.ArrayType(picked.schema[0].dataType), T.BinaryType(), T.BinaryType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch, data, offs in blocks(batches, "__text", GROUP_BYTES):
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([data.tobytes()], pa.binary()), pa.array([np.diff(offs).astype(np.int32).tobytes()], pa.binary())], names=names)
            number += 1

    return picked.mapInArrow(run, T.StructType([T.StructField(a, b) for a, b in zip(names, kinds, strict=True)]))


def _lines(table: pa.Table | pa.RecordBatch, k: int) -> Lines:
    cell = lambda name: table.column(table.schema.get_field_index(name))[k]
    ids = cell("ids").values.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
    return Lines(ids, np.frombuffer(cell("data").as_buffer(), np.uint8), np.frombuffer(cell("sizes").as_buffer(), np.int32))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_lines, n_chunks, n_removed_chunks (of which no line is left), n_removed_lines, kept (the lines left, joined by line feeds) and kept_sha256."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    columns = ["part", "ids", "data", "sizes"]
    groups = Table(packed(docs, id_col, text_col), "line-groups", "zstd", max(8, min(MAX_BUCKETS, -(-size // (4 * GROUP_BYTES)))), "part").df.select(*columns)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, number = _lines(batch, k), batch.column(batch.schema.get_field_index("part"))[k].as_py()
                first, times = x.distinct()
                arrays = (x.one[first], x.two[first].astype(np.int64), np.full(len(first), number), x.ids[x.doc[first]], x.place()[first], x.begin[first], x.size[first], times)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["one", "two", "part", "id", "place", "at", "size", "times"])

    def handed(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of the blocks that this group has first, taken from where ``listed`` found them."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"one": pa.array([], pa.int64()), "two": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "place": pa.array([], pa.int64()), "bytes": pa.array([], pa.binary())})
        data = np.frombuffer(left.column("data")[0].as_buffer(), np.uint8)
        at, size = (right.column(c).to_pylist() for c in ("at", "size"))
        texts = [data[a : a + n].tobytes() for a, n in zip(at, size, strict=True)]
        return pa.table({**{c: right.column(c) for c in ("one", "two", "id", "place")}, "bytes": pa.array(texts, pa.binary())})

    names = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in names), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        x = _lines(left, 0)
        n = len(x.ids)
        one, two, ids, places = (right.column(c).to_numpy() for c in ("one", "two", "id", "place"))
        data, offs = flat(right.column("bytes"))
        which = x.find(one, two.astype(np.uint32))
        some = np.flatnonzero(which >= 0)
        which = which[some]
        same = np.diff(offs)[which] == x.size[some]
        same[same] = x.alike(x.begin[some[same]], x.size[some[same]], Ranges(data), offs[which[same]])
        gone = same & ((ids[which] != x.ids[x.doc[some]]) | (places[which] != x.place()[some]))
        some = some[gone]
        line_gone = covered(x.first[some], x.last[some] + 1, len(x.row))
        chunk_doc = x.row[x.chunk_first]
        chunk_gone = np.logical_and.reduceat(line_gone, x.chunk_first) if len(chunk_doc) else line_gone
        texts = x.without(line_gone)
        numbers = (np.bincount(x.row, minlength=n), np.bincount(chunk_doc, minlength=n), np.bincount(chunk_doc[chunk_gone], minlength=n), np.bincount(x.row[line_gone], minlength=n))
        return pa.Table.from_arrays([
            left.column("ids").combine_chunks().values, *(pa.array(v.astype(np.int64)) for v in numbers), pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ], names=schema.names)

    entries = Table(groups.mapInArrow(listed, "one long, two long, part long, id long, place long, at long, size long, times long"), "blocks", "zstd").df
    again = entries.groupBy("one", "two").agg(F.sum("times").alias("n"), F.min(F.struct("id", "place", "part", "at", "size")).alias("first")).where("n > 1")
    firsts = Table(again.select("one", "two", *(f"first.{c}" for c in ("id", "place", "part", "at", "size"))), "firsts").df
    by_part = groups.groupBy("part")
    originals = groups.select("part", "data").groupBy("part").cogroup(firsts.groupBy("part")).applyInArrow(handed, "one long, two long, id long, place long, bytes binary")
    originals = Table(originals, "originals", "zstd").df
    told = entries.select("one", "two", "part", "id", "place", "times").alias("e").join(originals.alias("o"), ["one", "two"])
    # A group that has a block once, and first, has nothing to remove.
    told = told.where("e.times > 1 OR e.id <> o.id OR e.place <> o.place").select("e.part", "one", "two", "o.id", "o.place", "bytes")
    return by_part.cogroup(told.groupBy("part")).applyInArrow(finish, schema)
