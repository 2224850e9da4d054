"""Random orders of md5 digests and sums over them, with no row moved: a task draws whole repetitions from its own copy of the ranks.

Digests of short keys are taken of many at once (MD5 as in RFC 1321, one block); ``order_key`` gives the same ones.
Sums are whole numbers: products are multiplied in doubles over stretches short enough for a double to hold each sum exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of MD5: sines, rotations, which word each round takes, and the state it begins with.
SINES = [int(abs(x) * 2**32) for x in np.sin(np.arange(1, 65, dtype=np.float64)).tolist()]
TURNS = [t[k % 4] for t in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for k in range(16)]
TAKEN = [k % 16 for k in range(16)] + [(5 * k + 1) % 16 for k in range(16)] + [(3 * k + 5) % 16 for k in range(16)] + [7 * k % 16 for k in range(16)]
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a key that one block holds beside its end mark and length.
ONE_BLOCK = 55
#: Keys hashed at once: their buffers fit a core's cache.
AT_ONCE = 1 << 14
#: Doubles of accuracies that a task moves at once.
MOVED = 1 << 22
#: Repetitions of a task.
TASK_REPS = 25
WORD = (1 << 32) - 1


def _md5(n: int, fixed: list[int], varied: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of n blocks as two big-endian numbers each. A block's words are the sums of what all have and what differs."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in STATE)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k, (sine, turn, word) in enumerate(zip(SINES, TURNS, TAKEN, strict=True)):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += np.uint32((sine + fixed[word]) & WORD)
        if word in varied:
            f += varied[word]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= t
        np.add(b, f, out=a)
        a, b, c, d = d, a, b, c
    whole = [(x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in zip((a, b, c, d), STATE, strict=True)]
    return whole[0] << np.uint64(32) | whole[1], whole[2] << np.uint64(32) | whole[3]


class Keys:
    """Ends of keys, whose digests are taken after one beginning and another."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.sizes = data, offs, np.diff(offs)
        self.longest = int(self.sizes.max(initial=0))
        self._size, self._blocks = -1, []

    def _laid(self, size: int) -> list[tuple[int, list[int], dict[int, np.ndarray]]]:
        """For beginnings of so many bytes, stretches of the keys: how many, the words that all of them share, those that differ."""
        if size != self._size:
            self._size, self._blocks = size, []
            for at in range(0, len(self.sizes), AT_ONCE):
                sizes = self.sizes[at : at + AT_ONCE]
                block = np.zeros((len(sizes), 64), np.uint8)
                row = np.repeat(np.arange(len(sizes)), sizes)
                start, end = self.offs[at], self.offs[at + len(sizes)]
                block[row, size + np.arange(start, end) - np.repeat(self.offs[at : at + len(sizes)], sizes)] = self.data[start:end]
                block[np.arange(len(sizes)), size + sizes] = 0x80
                words = block.view("<u4").astype(np.uint32)
                words[:, 14] = (size + sizes) * 8
                same = (words == words[0]).all(axis=0)
                self._blocks.append((len(sizes), [int(words[0, j]) if same[j] else 0 for j in range(16)], {int(j): words[:, j].copy() for j in np.flatnonzero(~same)}))
        return self._blocks

    def digests(self, beginning: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The digest of ``beginning`` and each key, as two numbers."""
        if len(beginning) + self.longest > ONE_BLOCK:
            begun, data, offs = hashlib.md5(beginning, usedforsecurity=False), self.data.tobytes(), self.offs.tolist()
            out = bytearray()
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                (h := begun.copy()).update(data[a:b])
                out += h.digest()
            both = np.frombuffer(out, ">u8").astype(np.uint64).reshape(-1, 2)
            return both[:, 0].copy(), both[:, 1].copy()
        first = np.frombuffer(beginning.ljust(64, b"\0"), "<u4").tolist()
        found = [_md5(n, [x + y for x, y in zip(fixed, first, strict=True)], varied) for n, fixed, varied in self._laid(len(beginning))]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.uint64))

    def order(self, beginning: bytes) -> np.ndarray:
        """The keys along their digests, equals as they stand."""
        high, low = self.digests(beginning)
        order = np.argsort(high)
        rising = high[order]
        return np.lexsort((low, high)) if (rising[1:] == rising[:-1]).any() else order


@dataclass
class Ranks:
    """Doubled ranks of wordings in the order of their ids: of the accuracies, and a row a feature."""

    data: np.ndarray
    offs: np.ndarray
    ry: np.ndarray
    rx: np.ndarray
    most: int

    def products(self, seed: int, reps: list[int]) -> np.ndarray:
        """A row a repetition: for each feature the sum of its ranks times those of the accuracies along that repetition's order."""
        if not hasattr(self, "_keys"):
            self._keys = Keys(self.data, self.offs)
        n, out = len(self.ry), np.zeros((len(reps), len(self.rx)), np.int64)
        step, stretch = max(1, MOVED // max(n, 1)), (1 << 53) // max(self.most, 1) ** 2
        for first in range(0, len(reps), step):
            now = reps[first : first + step]
            moved = np.empty((len(now), n), np.float64)
            for k, rep in enumerate(now):
                moved[k] = self.ry[self._keys.order(f"{seed}|{rep}".encode())]
            for at in range(0, n, min(stretch, 1 << 14)):
                to = at + min(stretch, 1 << 14)
                out[first : first + step] += (moved[:, at:to] @ self.rx[:, at:to].T.astype(np.float64)).astype(np.int64)
        return out


def holds(rows: int, most: int) -> bool:
    """Whether doubles hold single products, and longs their sums."""
    return most < 1 << 26 and rows * most**2 < 1 << 63


def rank_products(wide: DataFrame, features: list[int], reps: int, seed: int, most: int) -> DataFrame:
    """(rep, ord, xy) from (p, ry, rx and the feature's number, at), which the driver and each worker hold: 4 bytes a rank."""
    spark = wide.sparkSession
    names = ["ry", *(f"rx{k}" for k in features)]
    key = F.concat_ws("|", F.lit(""), F.col("p").cast("string")).alias("key")
    table = wide.select("at", key, *(F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in names)).toArrow()
    order = np.argsort(table["at"].to_numpy())
    keys = table["key"].cast(pa.large_binary()).combine_chunks().take(pa.array(order))
    offs = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(keys) else np.empty(0, np.uint8)
    ranks = [table[c].to_numpy()[order] for c in names]
    sent = spark.sparkContext.broadcast(Ranks(data.copy(), offs - offs[0], ranks[0], np.array(ranks[1:], np.int32).reshape(len(features), len(order)), most))
    del table, keys, ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column(0).to_pylist()
            xy = sent.value.products(seed, drawn)
            columns = np.repeat(np.array(drawn, np.int32), len(features)), np.tile(np.array(features, np.int32), len(drawn)), xy.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "ord", "xy"])

    return spark.range(0, reps, 1, max(1, reps // TASK_REPS)).mapInArrow(run, "rep int, ord int, xy long")
