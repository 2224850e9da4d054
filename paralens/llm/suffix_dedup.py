"""Exact removal of long repeated byte strings, with run-length indexes of the places in doubt.

A byte goes if a string of ``span`` bytes that covers it also starts in a document of a smaller id.

1. Texts are packed into chunks. Every window of ``span`` bytes picks its anchor, the GRAM bytes in
   it of the smallest hash, so equal windows anywhere pick equal anchors at equal places.
2. Chunks deal their anchors' hashes to buckets, with a hash of the context, all bytes that a
   window with this anchor can reach. An anchor whose whole context an earlier document holds needs
   nothing more. Anchors with several contexts are in doubt: that is where repeats begin and end.
3. The windows in doubt meet by anchor. Those that share no longer stretch around it with another
   document are set aside; of the rest each bucket builds a suffix array, keeps its
   Burrows-Wheeler transform as runs with the suffix-array entries of the run ends, and streams the
   windows through the runs backwards; each finds the interval of rows with which it has a match of
   ``span`` bytes or more, and the smallest id there decides. A bucket is indexed in portions of whole anchors.
4. Anchors of more than HOT contexts, as a run of spaces has them, would all meet in one place. Their windows are
   dealt one by one instead, by a hash of the window.
5. Chunks gather the answers, mark what is covered and hash what is left.

So work follows the bytes of the corpus, however often a passage repeats: copies collapse in step 2
into one entry an anchor and chunk, and rows never outnumber entries. The chunks are a bucketed
table in the shared folder and never move; a lost executor reads them again.

Contexts, and windows of step 4, count as equal if two hashes of theirs, of 64 and of 32 bits, and 32 bits of their
anchors' hashes agree, 128 bits in all; everything in doubt is compared by its bytes.
Null texts are empty; null ids come after all others and, like rows of one id, remove nothing from each other; an
empty table gives an empty result. Ids are integers; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import MAX_BUCKETS, Table
from .cells import Deal, bucket_of, cut, read
from .ragged import DOC_MIX, STEP, U64, Hashes, blocks, mixed, runs, spread

SPAN, GRAM = 50, 16
CHUNK_BYTES = 4 << 20
BUCKET_ANCHORS = 1_000_000
LAST = np.iinfo(np.int64).max
#: What a context's first entry of a chunk is told: an earlier document has it; its anchor has several contexts; it has very many.
EARLIER, SEVERAL, MANY = 1, 2, 4
#: Contexts of an anchor beyond which its windows are dealt one by one.
HOT = 2000
#: Bytes of windows in doubt that are indexed at once, or those of one anchor.
PORTION = 4 << 20
SEPARATOR = 0xFF  # no byte of UTF-8
HIGH, LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)


def anchors(data: np.ndarray, offs: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of every anchor, and the first and last start of the windows that pick it."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    width, picked = span - gram + 1, np.empty(n - span + 1, np.int32)  # a cell has less than 2 GB
    for low in range(0, len(picked), STEP):  # what a step makes stays in the processor's cache
        high = min(low + STEP, len(picked))
        m = high - low + width - 1
        h = word[low : low + m] * U64(0x9E3779B97F4A7C15)
        h ^= word[low + gram - 8 : low + gram - 8 + m] * U64(0xC2B2AE3D27D4EB4F)
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
        h *= U64(0x94D049BB133111EB)
        h &= HIGH
        h |= np.arange(m, dtype=U64)
        size = 1
        while size * 2 <= width:  # minima over 2, 4, 8, ... positions
            h = np.minimum(h[: len(h) - size], h[size:])
            size *= 2
        if width > size:
            h = np.minimum(h[: len(h) - (width - size)], h[width - size :])
        picked[low:high] = h & LOW
        picked[low:high] += np.int32(low)
    edges = np.unique(offs)[1:-1]
    across = np.maximum(edges - span + 1, 0)  # windows that reach into the next text
    whole = ~marked(*merged(across, np.minimum(edges, len(picked))), len(picked))
    step = picked[1:] != picked[:-1]  # so it is between windows of two texts
    first, last = whole.copy(), whole.copy()
    first[1:] &= step | ~whole[:-1]
    last[:-1] &= step | ~whole[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return picked[first].astype(np.int64), first, last


class Chunk:
    """The texts of a chunk row with their anchors."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, sizes: np.ndarray, packed: tuple[np.ndarray, ...] | None, span: int = SPAN):
        self.ids, self.data = ids, data
        self.offs = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.at, self.first, self.last = packed if packed is not None else anchors(data, self.offs, span)
        self.span = span

    @cached_property
    def row(self) -> np.ndarray:
        return np.searchsorted(self.offs, self.at, "right") - 1

    @cached_property
    def low(self) -> np.ndarray:
        return np.maximum(self.offs[self.row], self.at - (self.span - GRAM))

    @cached_property
    def high(self) -> np.ndarray:
        return np.minimum(self.offs[self.row + 1], self.at + self.span)

    def contexts(self) -> Entries:
        """The context of each anchor, with its anchor's hash."""
        one, two = Hashes(self.data), Hashes(self.data, 1)
        at = (self.at - self.low).astype(U64) * DOC_MIX
        c = mixed(one.of(self.low, self.high) + at)
        return Entries(one.of(self.at, self.at + GRAM), c, two.of(self.low, self.high).astype(np.uint32), self.ids[self.row])

    def windows(self, some: np.ndarray, span: int) -> tuple[np.ndarray, Entries]:
        """Starts of the windows that pick the anchors ``some``, and the windows."""
        if not len(some):
            return np.zeros(0, np.int64), Entries(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.uint32), self.ids[:0])
        n = self.last[some] - self.first[some] + 1
        start, row = spread(self.first[some], n), np.repeat(self.row[some], n)
        one, two = Hashes(self.data), Hashes(self.data, 1)
        h = one.of(start, start + span)
        return start, Entries(mixed(h), h, two.of(start, start + span).astype(np.uint32), self.ids[row])


def ordered(key: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which entries of equal hashes follow one another, and where new ones begin. ``key``: what hashes are told apart by nearly always, and ordered by."""
    order = np.argsort(key)

    def changes(values: np.ndarray) -> np.ndarray:
        along = values[order]
        return along[1:] != along[:-1]

    fresh = changes(key)
    if any((changes(h) & ~fresh).any() for h in hashes):
        order = np.lexsort((*reversed(hashes), key))
        fresh = np.logical_or.reduce([changes(h) for h in hashes])
    return order, np.concatenate([np.ones(min(1, len(key)), bool), fresh])


class Entries:
    """Strings of a chunk by their hashes: ``group`` says where they meet, ``one`` and ``two`` whether they are equal."""

    def __init__(self, group: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray):
        order, fresh = ordered(one, one, two)
        number = np.cumsum(fresh) - 1
        self.of = np.empty(len(order), np.int64)  # which distinct string each is
        self.of[order] = number
        heads = np.flatnonzero(fresh)
        self.doc = np.minimum.reduceat(doc[order], heads) if len(heads) else doc[:0]  # the smallest id here
        self.later = doc > self.doc[self.of]
        lead = order[heads]
        self.group, self.one, self.two = group[lead], one[lead], two[lead]

    def deal(self, chunk: int, buckets: int) -> pa.RecordBatch:
        d = Deal(bucket_of(self.group, buckets))
        columns = (self.group.astype(np.uint32), self.one, self.two, self.doc)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(d.buckets), chunk)), pa.array(d.buckets), *(d.cells(c) for c in columns)], names=DEALT)

    def told(self, buckets: int, rows: pa.Table) -> np.ndarray:
        """What each string was told, for every entry: EARLIER also where this chunk has it in an earlier document."""
        d = Deal(bucket_of(self.group, buckets))
        status = d.back(rows.column("bucket").to_pylist(), rows.column("status").to_pylist(), np.uint8)[self.of]
        return status | np.where(self.later, EARLIER, 0).astype(np.uint8)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches that these ranges cover, none of which touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(starts)), bool), starts[1:] > ends[:-1]]))
    return starts[fresh], ends[np.append(fresh[1:], len(ends))[: len(fresh)] - 1]


def marked(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in stretches that don't touch and hold a position or more."""
    step = np.zeros(n + 1, np.int8)
    step[starts], step[ends] = 1, -1
    return np.cumsum(step[:n], dtype=np.int8).view(bool)


DEALT = ["chunk", "bucket", "groups", "ones", "twos", "docs"]
DEALT_TYPE = "chunk long, bucket long, groups binary, ones binary, twos binary, docs binary"


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def packed(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """One row a chunk: ids, bytes, sizes and anchors."""
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    names = ["chunk", "ids", "data", "sizes", "anchors", "firsts", "n_anchors"]
    kinds = [T.LongType(), T.ArrayType(picked.schema[0].dataType), *[T.BinaryType()] * 4, T.LongType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch, data, offs in blocks(batches, "__text", CHUNK_BYTES):
            at, first, last = anchors(data, offs, span)
            # Steps between anchors and lengths fit small numbers, which compress.
            arrays = [data, np.diff(offs).astype(np.int32), np.diff(at, prepend=0).astype(np.int32), np.stack([at - first, last - first]).astype(np.int16)]
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                *(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([len(at)], pa.int64()),
            ], names=names)
            number += 1

    return picked.mapInArrow(run, T.StructType([T.StructField(a, b) for a, b in zip(names, kinds, strict=True)]))


def _chunk(table: pa.Table | pa.RecordBatch, k: int, span: int) -> Chunk:
    cell = lambda name: table.column(table.schema.get_field_index(name))[k]
    read = lambda name, kind: np.frombuffer(cell(name).as_buffer(), kind)
    at = np.cumsum(read("anchors", np.int32), dtype=np.int64)
    back, more = read("firsts", np.int16).astype(np.int64).reshape(2, -1)
    return Chunk(_ids(cell("ids").values), read("data", np.uint8), read("sizes", np.int32), (at, at - back, at - back + more), span)


def _status(group: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """What every entry of a bucket is told."""
    out = np.zeros(len(group), np.uint8)
    if not len(group):
        return out
    # The key begins with all of the group's hash, so groups stay together.
    order, fresh = ordered((group.astype(U64) << U64(32)) | (one >> U64(32)), group, one, two)
    group, doc = group[order], doc[order]
    heads = np.flatnonzero(fresh)
    earliest = np.minimum.reduceat(doc, heads)
    group = group[heads]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    held = np.diff(np.append(first, len(heads)))
    several = np.minimum.reduceat(earliest, first) < np.maximum.reduceat(earliest, first)
    of_group = np.repeat(several * SEVERAL + (held > HOT) * MANY, held).astype(np.uint8)
    which = np.cumsum(fresh) - 1
    out[order] = np.where(doc > earliest[which], EARLIER, 0).astype(np.uint8) | of_group[which]
    return out


def judge(table: pa.Table) -> pa.Table:
    cells = [read(table.column(c), t) for c, t in zip(DEALT[2:], (np.uint32, np.uint64, np.uint32, np.int64), strict=True)]
    status = _status(*(np.concatenate(c) for c in cells))
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "status": cut(status, np.cumsum([len(c) for c in cells[0]]))})


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of byte strings, with the suffix-array entries of run ends.

    ``strings`` are laid out one after another, each with a separator that is unlike any other and
    smaller the earlier it stands. ``floor`` of a row is the smallest id among the rows that share
    its first ``span`` bytes, kept once for each such block.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, span: int = SPAN):
        n = len(data) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        text = np.full(n, SEPARATOR, np.uint8)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data
        self.ends = ends
        left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes before the separator
        order, rank = self._sorted(text, left)
        before = text[order - 1]  # the byte before each suffix; of the first, the last separator
        fresh = np.concatenate([[True], before[1:] != before[:-1]])
        # Separators are unlike each other: each is a run.
        fresh |= before == SEPARATOR
        fresh[1:] |= before[:-1] == SEPARATOR
        self.starts = np.flatnonzero(fresh)
        self.letters = before[self.starts]
        lengths = np.diff(np.append(self.starts, n))
        self.run_ends = order[self.starts + lengths - 1]
        count = np.bincount(text, minlength=256)
        base = np.cumsum(count) - count
        by_letter = np.argsort(self.letters, kind="stable")
        along = np.cumsum(lengths[by_letter]) - lengths[by_letter]
        first_of = along[np.searchsorted(self.letters[by_letter], self.letters[by_letter])]
        self.target = np.zeros(len(lengths), np.int64)  # row of the first suffix of a run, one letter longer
        self.target[by_letter] = base[self.letters[by_letter]] + along - first_of
        self.row_of_end = rank[ends]
        # Rows that share ``span`` bytes: where neighbours differ earlier, a block begins.
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
        long = left[order] >= span
        new = np.ones(n, bool)
        a, b = order[:-1], order[1:]
        both = np.flatnonzero(long[:-1] & long[1:])
        alike = np.ones(len(both), bool)
        hashes = Hashes(text)
        alike = hashes.of(a[both], a[both] + span) == hashes.of(b[both], b[both] + span)
        sure = both[alike]
        same = np.ones(len(sure), bool)
        for k in range(0, span, 8):  # byte by byte; the hash has only picked the candidates
            j = min(k, span - 8)
            same &= self._words(text, a[sure] + j) == self._words(text, b[sure] + j)
        new[sure[same] + 1] = False
        self.blocks = np.flatnonzero(new)
        self.floors = np.minimum.reduceat(ids[owner], self.blocks)

    @staticmethod
    def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))[at]

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and its inverse, by doubling from eight bytes; only what is still tied is sorted again. Suffixes end at their separators."""
        n = len(text)
        word = np.ndarray((n,), ">u8", np.concatenate([text, np.full(8, SEPARATOR, np.uint8)]), strides=(1,)).astype(np.uint64)
        ended = left < 8
        word[ended] |= U64(0xFFFFFFFFFFFFFFFF) >> (left[ended].astype(U64) * U64(8))
        order = np.argsort(word)
        word = word[order]
        short = np.flatnonzero(ended[order])  # equals that have ended stand in the order of their separators
        order[short] = order[short][np.lexsort((order[short], word[short]))]
        same = np.zeros(n, bool)  # as the suffix before
        same[1:] = (word[1:] == word[:-1]) & ~ended[order][1:]
        rank = np.empty(n, np.int64)
        slots, depth = np.arange(n), 8
        while True:
            # Ranks are the first slots of groups, so those of settled suffixes stay.
            rank[order[slots]] = slots[np.maximum.accumulate(np.where(same, 0, np.arange(len(slots))))]
            tied = same.copy()
            tied[:-1] |= same[1:]
            slots = slots[tied]
            if not len(slots):
                return order, rank
            which = order[slots]
            key = (rank[which] << 32) | rank[which + depth]
            turn = np.argsort(key)
            key = key[turn]
            order[slots] = which[turn]
            same = np.zeros(len(slots), bool)
            same[1:] = key[1:] == key[:-1]
            depth *= 2

    def backwards(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Streams the indexed strings from their ends: which of them are at a byte, and the rows of what follows."""
        active, row = np.arange(len(sizes)), self.row_of_end.copy()
        for step in range(int(sizes.max(initial=0))):
            go = sizes[active] > step
            active, row = active[go], row[go]
            run = np.searchsorted(self.starts, row, "right") - 1
            row = self.target[run] + row - self.starts[run]
            yield active, row

    def floor(self, rows: np.ndarray) -> np.ndarray:
        return self.floors[np.searchsorted(self.blocks, rows, "right") - 1]


def earlier_windows(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each byte of the strings, whether the ``span`` bytes from it also stand in a string of a smaller id.

    Equal strings are indexed once, under their smallest id.
    """
    out = np.zeros(len(data), bool)
    if not len(sizes):
        return out
    starts = np.cumsum(sizes) - sizes
    _, one, of = np.unique(Hashes(data).of(starts, starts + sizes), return_index=True, return_inverse=True)
    alike = sizes == sizes[one][of]
    own = np.flatnonzero(alike)
    alike[own[np.unique(np.repeat(np.arange(len(own)), sizes[own])[data[spread(starts[own], sizes[own])] != data[spread(starts[one][of[own]], sizes[own])]])]] = False
    odd = np.flatnonzero(~alike)  # of equal hash but other bytes
    of[odd] = len(one) + np.arange(len(odd))
    one = np.concatenate([one, odd])
    least = np.full(len(one), LAST)
    np.minimum.at(least, of, ids)
    size = sizes[one]
    index = RunLengthIndex(data[spread(starts[one], size)], size, least, span)
    stop = np.cumsum(size)
    floor = np.full(int(size.sum()), LAST)
    for step, (which, rows) in enumerate(index.backwards(size), 1):
        if step >= span:  # matching statistics of at least span bytes from here on
            floor[stop[which] - step] = index.floor(rows)
    return floor[spread((stop - size)[of], sizes)] < np.repeat(ids, sizes)


#: Stretches around an anchor of which a shared window shares at least one.
STRETCHES = 3


def may_match(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which strings can share a window with one of another id. ``offsets``: where their anchors stand.

    A shared window reaches at least as far left of the anchor as one of the stretches' begins, and then as far right as that one ends.
    """
    starts = np.cumsum(sizes) - sizes
    at, hashes = starts + offsets, Hashes(data)
    lefts = np.linspace(0, span - GRAM + 1, STRETCHES + 1).astype(np.int64)
    out = np.zeros(len(sizes), bool)
    for low, high in zip(lefts[:-1], lefts[1:], strict=True):
        a, b = at - low, at + span - high + 1
        inside = np.flatnonzero((a >= starts) & (b <= starts + sizes))
        _, group = np.unique(hashes.of(a[inside], b[inside]), return_inverse=True)
        least, most = np.full(len(inside), LAST), np.full(len(inside), -LAST)
        np.minimum.at(least, group, ids[inside])
        np.maximum.at(most, group, ids[inside])
        out[inside[(least < most)[group]]] = True
    return out


def covered_starts(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which bytes start a window that a string of a smaller id holds, portion by portion of whole anchors."""
    starts = np.cumsum(sizes) - sizes
    anchor = Hashes(data).of(starts + offsets, starts + offsets + GRAM)
    order = np.argsort(anchor, kind="stable")
    fresh = np.concatenate([np.ones(min(1, len(order)), bool), anchor[order][1:] != anchor[order][:-1]])
    before = np.cumsum(sizes[order]) - sizes[order]
    portion = np.maximum.accumulate(np.where(fresh, before, 0)) // PORTION  # of an anchor's first byte
    hit = np.zeros(len(data), bool)
    edges = np.flatnonzero(np.diff(portion, prepend=-1))
    for low, high in zip(edges, np.append(edges[1:], len(order)), strict=True):
        some = order[low:high]
        text = data[spread(starts[some], sizes[some])]
        likely = may_match(text, sizes[some], ids[some], offsets[some], span)
        of_likely = np.repeat(likely, sizes[some])
        some = some[likely]
        hit[spread(starts[some], sizes[some])] = earlier_windows(text[of_likely], sizes[some], ids[some], span)
    return hit


def dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the bytes left) and kept_sha256."""
    if not GRAM + 8 <= span:
        raise ValueError("span is too short for its anchors")
    id_type = docs.select(F.col(id_col)).schema[0].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    files = max(8, min(MAX_BUCKETS, -(-size // (4 * CHUNK_BYTES))))
    chunks = Table(packed(docs, id_col, text_col, span), "chunks", "zstd", files, "chunk").df
    buckets = max(32, -(-(chunks.agg(F.sum("n_anchors")).first()[0] or 0) // BUCKET_ANCHORS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column(batch.schema.get_field_index("chunk"))[k].as_py()
                yield _chunk(batch, k, span).contexts().deal(number, buckets)

    asked_names = ["kind", "chunk", "bucket", "positions", "sizes", "ids", "offsets", "data"]
    asked_type = "kind int, chunk long, bucket long, positions binary, sizes binary, ids binary, offsets binary, data binary"
    sure_kind, doubt_kind, hot_kind = 0, 1, 2

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """What is surely covered, the windows in doubt by bucket, and those of hot anchors."""
        c, number = _chunk(left, 0, span), left.column("chunk")[0].as_py()
        entries = c.contexts()
        bucket = bucket_of(entries.group, buckets)[entries.of]
        status = entries.told(buckets, right)
        full = (status & EARLIER) > 0
        hot = np.flatnonzero(~full & ((status & MANY) > 0))
        doubt = np.flatnonzero(~full & ((status & MANY) == 0) & ((status & SEVERAL) > 0))
        start, windows = c.windows(hot, span)
        # Of equal windows here only the earliest document's may stay, and one of these asks.
        here = start[windows.later]
        low, high = merged(np.concatenate([c.low[full], here]), np.concatenate([c.high[full], here + span]))

        d = Deal(bucket[doubt])
        doubt = doubt[d.order]
        first, size = c.first[doubt], c.last[doubt] + span - c.first[doubt]
        byte_ends = np.concatenate([[0], np.cumsum(size)])[d.ends]
        w = Deal(bucket_of(windows.group, buckets))
        none = lambda n: pa.array([b""] * n, pa.binary())
        n_doubt, n_hot = len(d.buckets), len(w.buckets)
        parts = [
            [pa.array([low.astype(np.int64).tobytes()], pa.binary()), cut(first.astype(np.int64), d.ends), w.cells(windows.group.astype(np.uint32))],
            [pa.array([high.astype(np.int64).tobytes()], pa.binary()), cut(size.astype(np.int64), d.ends), w.cells(windows.two)],
            [none(1), cut(c.ids[c.row[doubt]], d.ends), w.cells(windows.doc)],
            [none(1), cut((c.at[doubt] - first).astype(np.int16), d.ends), none(n_hot)],
            [none(1), cut(c.data[spread(first, size)], byte_ends), w.cells(windows.one)],
        ]
        kinds = np.repeat([sure_kind, doubt_kind, hot_kind], [1, n_doubt, n_hot])
        where = np.concatenate([[0], d.buckets, w.buckets]).astype(np.int64)
        return pa.Table.from_arrays([pa.array(kinds, pa.int32()), pa.array(np.full(len(kinds), number)), pa.array(where), *(pa.concat_arrays(p) for p in parts)], names=asked_names)

    def solve(table: pa.Table) -> pa.Table:
        """Ranges covered in each chunk by the windows in doubt of one bucket."""
        at, size, ids, data, offset = (read(table.column(c), t) for c, t in (("positions", np.int64), ("sizes", np.int64), ("ids", np.int64), ("data", np.uint8), ("offsets", np.int16)))
        hit = covered_starts(np.concatenate(data), np.concatenate(size), np.concatenate(ids), np.concatenate(offset).astype(np.int64), span)
        place = np.concatenate([spread(a, s) for a, s in zip(at, size, strict=True)])
        ends = np.cumsum([len(d) for d in data])
        starts, stops = [], []
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            first, last = merged(p := np.unique(place[a:b][hit[a:b]]), p + span)
            starts.append(first.tobytes())
            stops.append(last.tobytes())
        n = table.num_rows
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "positions": pa.array(starts, pa.binary()), "sizes": pa.array(stops, pa.binary()), "status": pa.array([None] * n, pa.binary())})

    def judge_windows(table: pa.Table) -> pa.Table:
        told = judge(table.rename_columns(DEALT))
        none = pa.array([None] * table.num_rows, pa.binary())
        return pa.table({"chunk": told.column("chunk"), "bucket": told.column("bucket"), "positions": none, "sizes": none, "status": told.column("status")})

    out_schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _chunk(left, 0, span)
        ranged, hot = (right.filter(pa.compute.is_valid(right.column(x))) for x in ("positions", "status"))
        a, b = (np.concatenate([*read(ranged.column(x), np.int64), np.zeros(0, np.int64)]) for x in ("positions", "sizes"))
        if hot.num_rows:
            entries = c.contexts()
            flags = right.filter(pa.compute.is_valid(right.column("anchors")))
            status = entries.told(buckets, flags.select(["bucket", "anchors"]).rename_columns(["bucket", "status"]))
            start, windows = c.windows(np.flatnonzero(((status & EARLIER) == 0) & ((status & MANY) > 0)), span)
            gone = start[(windows.told(buckets, hot) & EARLIER) > 0]
            a, b = np.concatenate([a, gone]), np.concatenate([b, gone + span])
        gone = marked(*merged(a, b), len(c.data))
        n = len(c.ids)
        start, stop, row = runs(gone, c.offs)
        removed = np.bincount(row, weights=stop - start, minlength=n).astype(np.int64)
        kept = c.data[~gone].tobytes()
        edge = np.concatenate([[0], np.cumsum(np.diff(c.offs) - removed)])
        texts = [kept[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_arrays([
            left.column("ids").combine_chunks().values, pa.array(np.diff(c.offs)), pa.array(removed),
            pa.array(np.bincount(row, minlength=n)), pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ], names=out_schema.names)

    columns = ["chunk", "ids", "data", "sizes", "anchors", "firsts"]
    judged = Table(chunks.select(*columns).mapInArrow(deal, DEALT_TYPE).groupBy("bucket").applyInArrow(judge, "chunk long, bucket long, status binary"), "anchor-status", "zstd")
    by_chunk = chunks.select(*columns).groupBy("chunk")
    asked = Table(by_chunk.cogroup(judged.df.groupBy("chunk")).applyInArrow(settle, asked_type), "windows-in-doubt", "zstd").df
    answer_type = "chunk long, bucket long, positions binary, sizes binary, status binary"
    solved = asked.where(F.col("kind") == doubt_kind).select(*asked_names[1:]).groupBy("bucket").applyInArrow(solve, answer_type)
    hot = asked.where(F.col("kind") == hot_kind)
    answers = asked.where(F.col("kind") == sure_kind).select("chunk", "bucket", "positions", "sizes", F.lit(None).cast("binary").alias("status")).unionByName(solved)
    answers = answers.withColumn("anchors", F.lit(None).cast("binary"))
    if hot.limit(1).count():
        told = hot.select("chunk", "bucket", "positions", "data", "sizes", "ids").groupBy("bucket").applyInArrow(judge_windows, answer_type)
        # Chunks with hot windows find them again by what their anchors were told.
        mine = judged.df.join(hot.select("chunk").distinct(), "chunk", "left_semi")
        flags = mine.select("chunk", "bucket", *(F.lit(None).cast("binary").alias(c) for c in ("positions", "sizes")), F.lit(None).cast("binary").alias("status"), F.col("status").alias("anchors"))
        answers = answers.unionByName(told.withColumn("anchors", F.lit(None).cast("binary"))).unionByName(flags)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(finish, out_schema)
