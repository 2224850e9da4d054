"""Scores of a log-bilinear language model trained with noise-contrastive estimation.

Tokens are white-space words, lowered in A-Z, and one end a text. The most frequent words, whose number grows
with the vocabulary (HEADS_RATE times its size to the power HEADS_POWER), have vectors of their own; all others share TAILS
classes, by their first two bytes. ``log_bilinear`` has the network. Inside a tail class a word has its count less a
discount, and what the discounts leave is the probability of a word of that class that training never saw: one outcome
a class, as add-one smoothing has one for all. So every word of any corpus has a proper probability.

What is learnt from is all training text: exact counts of all tokens, and every training token with its context. Learners,
as many tasks as LEARNERS times the root of the number of chunks, each take chunks in turn, beginning with the parameters of the round before; the round's
result is their mean, weighted by tokens. There are ROUNDS rounds over parts of the chunks, so each token is met once, or more often if there are few.

Token counts are exact. Texts are tokenised once into chunks, each with its sorted distinct
tokens; chunks deal these to buckets of the hash range, a bucket adds them up, and every chunk gets
its own tokens' counts back. A token costs one entry a chunk however often it occurs, so frequent
tokens make no bucket large; a chunk sends no row to buckets for which it has nothing, so rows never outnumber entries.
What reaches the driver are sums, the head words and the network. Tokens are told apart by two hashes, of 64 and 32 bits.

Null texts are empty: one end. Null ids are held out. Repeated rows count and score one by one; of equally frequent
words those of smaller hashes come first; an empty table gives an empty result. How texts are dealt to chunks decides what learners
meet, so scores, though not base scores, differ a little between layouts of a table. Only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Table
from .cells import Deal, bucket_of, cut, read
from .log_bilinear import Network, Shape, Tokens
from .ragged import LOWER, SPACED_WORD, blocks, mixed, runs, word_hashes

CHUNK_BYTES = 4 << 20
#: Distinct tokens of chunks that a bucket adds up.
BUCKET_ENTRIES = 500_000
TAILS = 96
HEADS_RATE, HEADS_POWER = 8.0, 0.4
ROUNDS, LEARNERS, SEED = 4, 2, 4001
#: Tokens that are learnt from at least, in MOST_PASSES passes at most.
LEARNT, MOST_PASSES = 3_000_000, 24
#: Parameters that one task takes the mean of.
SLICE = 1 << 16
END, END_TWO = np.uint64(0xE07D_0F7E_57A1_1CE5), np.uint32(1)


def _chunk(data: np.ndarray, offs: np.ndarray, learn: np.ndarray) -> list[np.ndarray]:
    """Distinct tokens (sorted hashes), second hashes, tail classes and training counts; all tokens as indexes of those; tokens of each text."""
    n = len(offs) - 1
    lowered = LOWER[data]
    starts, ends, row = runs(SPACED_WORD[data], offs)
    h, h2 = word_hashes(lowered, starts, ends, (0, 1))
    h2 = h2.astype(np.uint32)
    two = lowered[starts].astype(np.uint64) * np.uint64(256)
    longer = ends - starts > 1
    two[longer] += lowered[starts[longer] + 1]
    count = np.bincount(row, minlength=n)
    at = np.arange(len(h)) + row  # one end after each text before
    tokens, second, kind = np.full(len(h) + n, END), np.full(len(h) + n, END_TWO), np.zeros(len(h) + n, np.int64)
    tokens[at], second[at] = h, h2
    kind[at] = (mixed(two) % np.uint64(TAILS)).astype(np.int64)
    first, index = distinct(tokens, second)
    seen = np.bincount(index[np.repeat(learn, count + 1)], minlength=len(first))
    return [tokens[first], second[first], kind[first].astype(np.uint8), seen.astype(np.int32), index.astype(np.int32), (count + 1).astype(np.int32)]


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct pair of hashes, in their order, and which of these every pair is."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    fresh, other = a[1:] != a[:-1], b[1:] != b[:-1]
    if (other & ~fresh).any():  # some share the first hash alone
        order = np.lexsort((two, one))
        fresh = fresh | (two[order][1:] != two[order][:-1])
    fresh = np.concatenate([np.ones(min(1, len(order)), bool), fresh])
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(fresh) - 1
    return order[fresh], index


def tokenised(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """One row a chunk of texts."""
    picked = docs.select(F.col(id_col).alias("__id"), held_out.alias("__held"), F.col(text_col).cast("string").alias("__text"))
    names = ["chunk", "nth", "ids", "held", "unique", "second", "kind", "seen", "tokens", "sizes", "entries"]
    kinds = [T.LongType(), T.LongType(), T.ArrayType(picked.schema[0].dataType), T.ArrayType(T.BooleanType()), *[T.BinaryType()] * 6, T.LongType()]
    schema = T.StructType([T.StructField(a, b) for a, b in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch, data, offs in blocks(batches, "__text", CHUNK_BYTES):
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            arrays = _chunk(data, offs, ~held)
            one = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([(part << 33) + nth]), pa.array([part + nth]), pa.ListArray.from_arrays(one, batch.column(0)), pa.ListArray.from_arrays(one, batch.column(1)),
                *(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([len(arrays[0])], pa.int64()),
            ], names=names)
            nth += 1

    return picked.mapInArrow(run, schema)


def stored(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """The chunks in a table of small row groups: tasks that read or write it hold two chunks or so, however large their files are."""
    return Table(tokenised(docs, held_out, id_col, text_col), "token-chunks", "zstd", group_mb=8).df


def _cells(batch: pa.RecordBatch | pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return read(batch.column(batch.schema.get_field_index(name)), kind)


def _cell(batch: pa.RecordBatch | pa.Table, k: int, name: str, kind: type) -> np.ndarray:
    """One row's values, where they are: a batch holds many chunks, which are not copied together."""
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_buffer(), kind)


@dataclass
class Sums:
    """What is known of training tokens: totals (all tokens, distinct ones, words seen once, words seen twice), tokens and words of each tail class, and frequent words."""

    totals: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    top: np.ndarray
    second: np.ndarray
    often: np.ndarray
    kind: np.ndarray

    def pack(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in (self.totals, self.tail_tokens, self.tail_words, self.top.view(np.int64), self.second, self.often, self.kind))

    @staticmethod
    def unpack(cell: bytes) -> Sums:
        x = np.frombuffer(cell, np.int64)
        fixed = 4 + 2 * TAILS
        top, second, often, kind = x[fixed:].reshape(4, -1)
        return Sums(x[:4], x[4 : 4 + TAILS], x[4 + TAILS : fixed], top.view(np.uint64), second, often, kind)

    @staticmethod
    def joined(parts: list[Sums], most: int) -> Sums:
        """The sums of all, with the ``most`` most frequent words."""
        empty = np.zeros(0, np.int64)
        add = lambda name, n: np.sum([np.zeros(n, np.int64), *(getattr(p, name) for p in parts)], axis=0)
        top, second, often, kind = (np.concatenate([getattr(p, name) for p in parts] or [empty]) for name in ("top", "second", "often", "kind"))
        best = np.lexsort((second, top, -often))[:most]
        return Sums(add("totals", 4), add("tail_tokens", TAILS), add("tail_words", TAILS), top.astype(np.uint64)[best], second[best], often[best], kind[best])


def counted(chunks: DataFrame, buckets: int, heads: int) -> DataFrame:
    """Rows (chunk, bucket, counts): corpus counts of that chunk's tokens in that bucket; and one a bucket with chunk -1, its sums and frequent words."""
    share = -(-3 * heads // (2 * buckets)) + 16  # hashes spread head words evenly over buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.column(batch.schema.get_field_index("chunk"))[k].as_py()
                unique, *others = (_cell(batch, k, c, t) for c, t in (("unique", np.uint64), ("second", np.uint32), ("kind", np.uint8), ("seen", np.int32)))
                d = Deal(bucket_of(unique, buckets))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d.buckets), chunk)), pa.array(d.buckets), *(d.cells(c) for c in (unique, *others))], names=["chunk", "bucket", "unique", "second", "kind", "seen"])

    def add(table: pa.Table) -> pa.Table:
        h, second, kind, seen = ([*_cells(table, c, t)] for c, t in (("unique", np.uint64), ("second", np.uint32), ("kind", np.uint8), ("seen", np.int32)))
        ends = np.cumsum([len(x) for x in h])
        h, second, kind, seen = (np.concatenate(x) for x in (h, second, kind, seen))
        first, index = distinct(h, second)
        total = np.bincount(index, weights=seen, minlength=len(first)).astype(np.int64)
        inner = (total > 0) & (h[first] != END)
        tail = kind[first]
        known = np.flatnonzero(inner)
        best = known[np.lexsort((second[first][known], h[first][known], -total[known]))[:share]]
        sums = Sums(
            np.array([total.sum(), (total > 0).sum(), (inner & (total == 1)).sum(), (inner & (total == 2)).sum()]), np.bincount(tail[inner], weights=total[inner], minlength=TAILS),
            np.bincount(tail[inner], minlength=TAILS), h[first][best], second[first][best].astype(np.int64), total[best], tail[best].astype(np.int64),
        )
        bucket = table.column("bucket").combine_chunks()
        return pa.table({
            "chunk": pa.concat_arrays([table.column("chunk").combine_chunks(), pa.array([-1], pa.int64())]), "bucket": pa.concat_arrays([bucket, bucket[:1]]),
            "counts": pa.concat_arrays([cut(total[index], ends), pa.array([sums.pack()], pa.binary())]),
        })

    dealt = chunks.select("chunk", "unique", "second", "kind", "seen").mapInArrow(deal, "chunk long, bucket long, unique binary, second binary, kind binary, seen binary")
    return dealt.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, counts binary")


def summed(replies: DataFrame, heads: int) -> Sums:
    """Sums over all buckets and the ``heads`` most frequent words, from at most 64 partial sums."""

    def some(table: pa.Table) -> pa.Table:
        joined = Sums.joined([Sums.unpack(x) for x in table.column("counts").to_pylist()], 2 * heads // 64 + 64)
        return pa.table({"counts": pa.array([joined.pack()], pa.binary())})

    rows = replies.where("chunk = -1").select((F.col("bucket") % 64).alias("part"), "counts").groupBy("part").applyInArrow(some, "counts binary").collect()
    return Sums.joined([Sums.unpack(bytes(r[0])) for r in rows], heads)


class Classes:
    """Head words and tail classes of tokens."""

    def __init__(self, sums: Sums):
        n = len(sums.top)
        self.shape = Shape(n, max(1, int(2 * np.sqrt(n))), TAILS)
        self.tokens, self.distinct = int(sums.totals[0]), int(sums.totals[1])
        order = np.argsort(sums.top, kind="stable")
        self.top, self.second, self.rank = sums.top[order], sums.second[order].astype(np.uint32), order
        self.often = sums.often.astype(np.float64)
        once, twice = (int(x) for x in sums.totals[2:4])
        self.discount = (once + 1) / (once + 2 * twice + 2)
        # What is left in each tail class once the head words are taken out.
        self.tail_tokens = sums.tail_tokens - np.bincount(sums.kind, weights=sums.often, minlength=TAILS)
        self.tail_words = sums.tail_words - np.bincount(sums.kind, minlength=TAILS)

    def words(self, unique: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which head word each of the sorted tokens is, or -1."""
        out, at = np.full(len(unique), -1), np.searchsorted(self.top, unique)
        left = np.flatnonzero(at < len(self.top))
        while len(left):  # once, unless tokens share the first hash alone
            left = left[self.top[at[left]] == unique[left]]
            same = self.second[at[left]] == second[left]
            out[left[same]] = self.rank[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(self.top)]
        return out

    def shares(self, ends: int) -> tuple[np.ndarray, np.ndarray]:
        """Of outputs and of head words, smoothed by one. ``ends``: training texts."""
        in_class = np.bincount(np.arange(self.shape.heads) % self.shape.classes, weights=self.often, minlength=self.shape.classes)
        outputs = np.concatenate([in_class, self.tail_tokens, [ends]]) + 1.0
        return outputs / outputs.sum(), (self.often + 1) / (self.often + 1).sum()

    def place(self, unique: np.ndarray, second: np.ndarray, kind: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> Tokens:
        """All tokens of a chunk with their contexts."""
        shape, word, kind = self.shape, self.words(unique, second), kind.astype(np.int64)
        end = (unique == END) & (second == END_TWO)
        output = np.where(word >= 0, word % shape.classes, shape.classes + kind)
        output[end] = shape.outputs - 1
        context = np.where(word >= 0, word, shape.heads + kind)
        before = shape.contexts - 1
        first = np.cumsum(sizes) - sizes
        one = np.full(len(tokens), before)
        one[1:] = context[tokens[:-1]]
        one[first] = before
        two = np.full(len(tokens), before)
        two[1:] = one[:-1]
        two[first] = before
        return Tokens(output[tokens], word[tokens], one, two)

    def within_tail(self, counts: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of tokens of these counts in their tail classes; a count of 0 is any word that was never seen."""
        held, words = self.tail_tokens[kind], self.tail_words[kind]
        known = np.maximum(counts - self.discount, 1e-300) / np.maximum(held, 1e-300)
        unseen = np.where(held > 0, self.discount * words / np.maximum(held, 1), 1.0)
        return np.log(np.where(counts > 0, known, np.maximum(unseen, 1e-300)))


COLUMNS = ("unique", "second", "kind", "tokens", "sizes")
KINDS = (np.uint64, np.uint32, np.uint8, np.int32, np.int32)


def train(chunks: DataFrame, classes: Classes, ends: int, learnt: int = LEARNT, seed: int = SEED) -> Network:
    """The network after ROUNDS rounds of learners."""
    spark, shares = chunks.sparkSession, classes.shares(ends)
    net = Network.fresh(classes.shape, *shares, seed)
    passes = max(1, min(MOST_PASSES, -(-learnt // max(1, classes.tokens))))
    parts, again = max(1, ROUNDS // passes), max(1, passes // ROUNDS)
    learners = max(8, int(LEARNERS * np.sqrt(chunks.count())))  # each hands over all parameters
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((classes, shares, net))  # sublinear in the vocabulary

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            known, (outputs, words), start = sent.value
            mine, weight = Network(known.shape, start.flat.copy()), 0
            for batch in batches:
                for row in range(batch.num_rows):
                    out, chunk = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("held", "chunk"))
                    arrays = [_cell(batch, row, c, t) for c, t in zip(COLUMNS, KINDS, strict=True)]
                    some = np.flatnonzero(np.repeat(~np.array(out, bool), arrays[-1]))
                    if len(some):
                        tokens = known.place(*arrays).take(some)
                        for k in range(again):
                            mine.learn(tokens, outputs, words, np.random.default_rng([seed, turn, k, chunk]))
                        weight += len(some)
            if weight:
                slices = range(0, len(mine.flat), SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slices))), pa.array(np.full(len(slices), weight)), pa.array([mine.flat[a : a + SLICE].tobytes() for a in slices], pa.binary())], names=["slice", "weight", "values"])

        def mean(table: pa.Table) -> pa.Table:
            weight = table.column("weight").to_numpy().astype(np.float64)
            total = sum(w * x for w, x in zip(weight, read(table.column("values"), np.float32), strict=True)) / weight.sum()
            return pa.table({"slice": table.column("slice")[:1], "values": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        now = chunks.where(F.pmod(F.col("nth"), F.lit(parts)) == turn % parts).select("chunk", "held", *COLUMNS).coalesce(learners)
        rows = now.mapInArrow(learn, "slice long, weight long, values binary").groupBy("slice").applyInArrow(mean, "slice long, values binary").collect()
        if rows:
            net = Network(classes.shape, np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows)]))
        sent.unpersist()
    return net


def heads_of(entries: int) -> int:
    """How many words have vectors of their own, for so many distinct tokens of chunks."""
    return int(HEADS_RATE * max(1, entries) ** HEADS_POWER)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one shares alone) and score, both log10 of the whole text's probability.

    ``held_out``: true for rows that the model doesn't learn from.
    """
    chunks = stored(docs, held_out, id_col, text_col)
    entries, ends = (x or 0 for x in chunks.agg(F.sum("entries"), F.sum(F.size(F.filter("held", lambda x: ~x)))).first())
    heads = heads_of(entries)
    replies = Table(counted(chunks, max(8, -(-entries // BUCKET_ENTRIES)), heads), "token-counts", "zstd")
    classes = Classes(summed(replies.df, heads))
    net = train(chunks, classes, ends)
    sent = docs.sparkSession.sparkContext.broadcast((classes, net))
    out_schema = T.StructType([
        T.StructField(id_col, docs.select(F.col(id_col)).schema[0].dataType), T.StructField("held_out", T.BooleanType()),
        *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    buckets = max(8, -(-entries // BUCKET_ENTRIES))

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        known, network = sent.value
        arrays = [_cell(left, 0, name, t) for name, t in zip(COLUMNS, KINDS, strict=True)]
        unique, _, kind, tokens, sizes = arrays
        d = Deal(bucket_of(unique, buckets))
        c = d.back(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), np.int64).astype(np.float64)
        base = np.log10((c + 1) / (known.tokens + known.distinct + 1))
        placed = known.place(*arrays)
        in_tail = (placed.word < 0) & (placed.output < known.shape.outputs - 1)
        each = network.log_probabilities(placed) + np.where(in_tail, known.within_tail(c, kind)[tokens], 0.0)
        starts, n = np.cumsum(sizes) - sizes, len(sizes)
        return pa.Table.from_arrays([
            left.column("ids").combine_chunks().values, left.column("held").combine_chunks().values, pa.array(sizes.astype(np.int64)),
            pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), starts)), pa.array(np.full(n, known.tokens)),
            pa.array(np.add.reduceat(base[tokens], starts)), pa.array(np.add.reduceat(each, starts) / np.log(10)),
        ], names=out_schema.names)

    asked = chunks.select("chunk", "ids", "held", *COLUMNS)
    return asked.groupBy("chunk").cogroup(replies.df.where("chunk >= 0").groupBy("chunk")).applyInArrow(rate, out_schema)
