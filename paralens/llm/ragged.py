"""Ragged byte arrays: whole Arrow string columns handled as flat numpy buffers.

A block is a run of rows whose texts sit in one ``uint8`` buffer with an offset per row. Words,
lines and n-grams are index ranges of that buffer, so nothing is turned into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd bases and multipliers of the hashes below; any odd values serve.
BASE = 0x9E3779B97F4A7C15
MIX_A = U64(0xBF58476D1CE4E5B9)
MIX_B = U64(0x94D049BB133111EB)
DOC_MIX = U64(0xD6E8FEB86659FD93)

BLOCK_BYTES = 4 << 20
#: Bytes whose hashes are made at once.
STEP = 1 << 15


def byte_table(ranges: list[tuple[int, int]], inside: bool = True) -> np.ndarray:
    """A 256-entry table that is true for bytes within (or outside) the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table if inside else ~table


#: Bytes of words that white space ends: everything but space and U+0009 to U+000D.
SPACED_WORD = byte_table([(0x20, 0x20), (0x09, 0x0D)], inside=False)
#: Bytes of words of lower-cased letters, digits and everything beyond ASCII.
PLAIN_WORD = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], inside=False)
#: The same before A-Z are lowered.
PLAIN_WORD_ANY_CASE = PLAIN_WORD | byte_table([(0x41, 0x5A)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that begin a code point.
CODE_POINT = byte_table([(0x80, 0xBF)], inside=False)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offs = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most ``limit`` text bytes, or of one row if that is longer."""
    for batch in batches:
        data, offs = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of true bytes; runs end with their row."""
    n = len(mask)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; every row has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([feeds, offs[1:]]), kind="stable")
    row = np.searchsorted(offs, feeds, "right") - 1
    return starts, ends, np.repeat(np.arange(len(offs) - 1), np.bincount(row, minlength=len(offs) - 1) + 1)


def per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many true bytes each row has."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, base, U64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if size > 4 * BLOCK_BYTES:
            return made
        _powers[:] = made
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits."""
    h = (h ^ (h >> U64(30))) * MIX_A
    h = (h ^ (h >> U64(27))) * MIX_B
    return h ^ (h >> U64(31))


#: The low 0 to 8 bytes of a word.
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def _mixed_words(word: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """A bijection of 64-bit words; ``word`` is not changed."""
    h = word * a
    h ^= h >> U64(32)
    h *= b
    h ^= h >> U64(29)
    return h


class Ranges:
    """Ranges of one buffer: their bytes as 8-byte words, and whether two are equal."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def text(self, start: int, size: int) -> bytes:
        return self.data[start : start + size].tobytes()

    def alike(self, starts: np.ndarray, size: np.ndarray, other: Ranges, at: np.ndarray) -> np.ndarray:
        """Whether ``size`` bytes from each of ``starts`` equal as many of ``other`` from ``at``."""
        mask = _LOW_BYTES[np.minimum(size, 8)]
        out = (self.words[starts] & mask) == (other.words[at] & mask)
        long = np.flatnonzero(out & (size > 8))
        if len(long):
            more = (size[long] - 1) // 8
            of, step = np.repeat(long, more), spread(np.ones(len(long), np.int64), more)
            place = np.minimum(8 * step, size[of] - 8)  # the last word ends where the range does
            out[of[self.words[starts[of] + place] != other.words[at[of] + place]]] = False
        return out


class Hashes(Ranges):
    """64-bit hashes of any ranges of one buffer, each in constant time from prefix sums.

    A range's hash is a polynomial of its 8-byte substrings, each mixed first, so that strings on whose letters
    a polynomial is zero (as Thue-Morse words and their complements) mean nothing. Hashes only pick candidates:
    whoever needs identity compares bytes (``identity``) or a second hash (another ``salt``).
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        super().__init__(data)
        power, self.inverse = _power_tables(len(data) + 1)
        self.mix = (MIX_A + U64(2 * salt), MIX_B + U64(4 * salt))
        self.total = np.empty(len(data) + 1, U64)
        self.total[0] = 0
        for low in range(0, len(data), STEP):  # what a step makes stays in the processor's cache
            high = min(low + STEP, len(data))
            mixed_ = _mixed_words(self.words[low:high], *self.mix)
            mixed_ *= power[low:high]
            mixed_[:1] += self.total[low : low + 1]
            np.cumsum(mixed_, out=self.total[low + 1 : high + 1])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = (self.total[np.maximum(ends - 7, starts)] - self.total[starts]) * self.inverse[starts]
        short = np.flatnonzero(size < 8)
        h[short] = _mixed_words(self.words[starts[short]] & _LOW_BYTES[size[short]], *self.mix)
        return mixed(h + size.astype(U64) * DOC_MIX)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: tuple[int, ...]) -> list[np.ndarray]:
    """What ``Hashes`` of these salts give, for ranges most of which are short: without sums over the whole buffer."""
    size = ends - starts
    long = np.flatnonzero(size >= 8)
    more = size[long] - 7
    if more.sum() > len(data) // 4:
        return [Hashes(data, salt).of(starts, ends) for salt in salts]
    words = Ranges(data).words
    short = words[starts] & _LOW_BYTES[np.minimum(size, 8)]
    inside, power = words[spread(starts[long], more)], _power_tables(int(more.max(initial=0)) + 1)[0][spread(np.zeros(len(long), np.int64), more)]
    first, tail, out = np.cumsum(more) - more, size.astype(U64) * DOC_MIX, []
    for salt in salts:
        mix = (MIX_A + U64(2 * salt), MIX_B + U64(4 * salt))
        h = _mixed_words(short, *mix)
        if len(long):
            h[long] = np.add.reduceat(_mixed_words(inside, *mix) * power, first)
        out.append(mixed(h + tail))
    return out


def identity(ranges: Ranges, h: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each range that only ranges of the same bytes share, and of each number one range. ``h``: their hashes.

    Numbers follow the hashes, those of ranges whose hash other bytes have as well come last.
    """
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    alike = (size == size[first][number]) & ranges.alike(starts, np.minimum(size, size[first][number]), ranges, starts[first][number])
    if not alike.all():
        own: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(~alike).tolist():
            text = ranges.text(int(starts[k]), int(size[k]))
            if text not in own:
                own[text] = len(first) + len(own)
                extra.append(k)
            number[k] = own[text]
        first = np.concatenate([first, np.array(extra, np.int64)])
    return number, first


def windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size`` consecutive items of a row, and the index of its first item."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: n] == row[size - 1 :])
    out = np.zeros(len(at), U64)
    for k in range(size):
        out = out * U64(BASE) + h[at + k]
    return mixed(out), at


def in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows."""
    return mixed(h + (row.astype(U64) + U64(1)) * DOC_MIX)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any of the ranges."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``counts`` of them."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total)
