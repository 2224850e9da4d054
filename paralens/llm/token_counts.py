"""Exact byte-level BPE token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a block of texts are ranges of one byte buffer. Distinct pre-tokens that the
worker hasn't met are laid out as one flat symbol array with a start per sequence; each round
finds the lowest merge rank of every sequence, merges all occurrences of that pair in every
sequence at once, and retires sequences without a mergeable pair. What survives is the count.

Pre-tokens follow the library's byte-level pattern, found from character classes instead of a
regular expression; a character's class is asked of the library's own pre-tokenizer once, as its
Unicode tables decide. Added special tokens inside texts count as one token each.

Equal pre-tokens are found by hash and compared by bytes. Null texts are empty (0 tokens, 0 bytes); repeated rows count one by one; a null id is kept as it
is; columns other than the id and text are ignored. A text is never cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import CODE_POINT, Hashes, Ranges, blocks, identity, spread

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
NO_RANK = np.int32(1 << 30)
#: Distinct pre-tokens whose counts a worker remembers; later ones are merged anew in each block.
REMEMBERED = 400_000
QUOTE = 0x27
CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


class Vocabulary:
    """What the merging needs of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("expected a plain byte-level BPE file")
        ids = model["vocab"]
        self.split = Tokenizer.from_file(path).pre_tokenizer
        # The letters that stand for bytes: printable bytes for themselves, the others from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.byte_id = np.array([ids[letter[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        #: Hashes, sorted, of pre-tokens met before, with where their bytes are kept, how many these are, and their counts.
        self.known, self.place, self.length, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.chars = Ranges(np.zeros(0, np.uint8))

    def kinds(self, code: np.ndarray) -> np.ndarray:
        """The class of each code point."""
        out = self.kind[code]
        if (out == UNKNOWN).any():
            for c in np.unique(code[out == UNKNOWN]):
                joins = lambda before: len(self.split.pre_tokenize_str(before + chr(c))) == 1  # noqa: E731, B023
                self.kind[c] = LETTER if joins("a") else NUMBER if joins("1") else OTHER if joins("!") else SPACE
            out = self.kind[code]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence; ``sizes`` are positive and add up to ``symbols``."""
        out = np.zeros(len(sizes), np.int32)
        alive = np.arange(len(sizes))
        rank = np.full(len(symbols), NO_RANK, np.int32)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[np.cumsum(sizes) - 1] = NO_RANK
        while len(alive):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            done = best == NO_RANK
            if done.any():
                out[alive[done]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, rank = symbols[keep], rank[keep]
                alive, sizes, best = alive[~done], sizes[~done], best[~done]
                if not len(alive):
                    break
            seq = np.repeat(np.arange(len(alive)), sizes)
            at = np.flatnonzero(rank == best[seq])
            new_run = np.ones(len(at), bool)  # of positions side by side, as in a a a: every other one merges
            new_run[1:] = np.diff(at) != 1
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(seq[at], minlength=len(alive))
            last = np.cumsum(sizes) - 1
            place = np.cumsum(keep) - 1
            symbols, rank = symbols[keep], rank[keep]
            now = place[at]
            for changed in (now, now[now > 0] - 1):
                right = np.minimum(changed + 1, len(symbols) - 1)
                rank[changed] = self.ranks(symbols[changed], symbols[right])
            rank[last] = NO_RANK
        return out

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each pre-token or special token, and which are special."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        inner = np.cumsum(cut)
        special_starts = []
        for content in self.special:
            at = np.flatnonzero(data[: n - len(content) + 1] == content[0]) if n >= len(content) else np.zeros(0, np.int64)
            for k in range(1, len(content)):
                at = at[data[at + k] == content[k]]
            at = at[inner[at] == inner[at + len(content) - 1]]
            cut[at] = cut[at + len(content)] = True
            special_starts.append((at, len(content)))

        pos = np.flatnonzero(CODE_POINT[data])
        code = data[pos].astype(np.int64)
        wide = np.flatnonzero(code >= 0xC0)
        lead, size = code[wide], 2 + (code[wide] >= 0xE0) + (code[wide] >= 0xF0)
        value = lead & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            value[more] = (value[more] << 6) | (data[pos[wide[more]] + k] & 0x3F)
        code[wide] = value
        kind = self.kinds(code)
        fresh = cut[pos]
        start = np.ones(len(pos), bool)
        space, same = kind == SPACE, kind[1:] == kind[:-1]
        follows_blank = code[:-1] == 0x20
        start[1:] = ~same & ~follows_blank
        start[1:] |= space[1:] & ~space[:-1]
        start[:-1] |= space[:-1] & ~space[1:] & ~fresh[1:]
        start |= fresh
        quote = np.flatnonzero((code == QUOTE) & start)
        for tail in CONTRACTIONS:
            at = quote[quote + len(tail) < len(pos)]
            for k, c in enumerate(tail, 1):
                at = at[(code[at + k] == c) & ~fresh[at + k]]
            start[at + 1] = False
            after = at + len(tail) + 1
            start[after[after < len(pos)]] = True
        starts = pos[start]
        is_special = np.zeros(len(starts), bool)
        if any(len(at) for at, _ in special_starts):
            inside = np.zeros(n + 1, np.int64)
            for at, size_ in special_starts:
                inside[at] += 1
                inside[at + size_] -= 1
            within = np.cumsum(inside)[starts] > 0
            is_special = within & cut[starts]
            starts, is_special = starts[~within | cut[starts]], is_special[~within | cut[starts]]
        return starts, np.append(starts[1:], n)[: len(starts)], is_special

    def _remember(self, h: np.ndarray, tokens: np.ndarray, some: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        some = some[np.unique(h[some], return_index=True)[1]]
        some = some[~np.isin(h[some], self.known)]
        if not len(some):
            return
        held = self.chars.data[:-8]
        at = len(held) + np.cumsum(size[some]) - size[some]
        self.chars = Ranges(np.concatenate([held, data[spread(starts[some], size[some])]]))
        order = np.argsort(np.concatenate([self.known, h[some]]), kind="stable")
        join = lambda old, new: np.concatenate([old, new])[order]
        self.known, self.place = join(self.known, h[some]), join(self.place, at)
        self.length, self.counts = join(self.length, size[some]), join(self.counts, tokens[some])

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        rows = len(offs) - 1
        if len(data) == 0:
            return np.zeros(rows, np.int64)
        starts, ends, special = self.spans(data, offs)
        row = np.searchsorted(offs, starts, "right") - 1
        total = np.bincount(row[special], minlength=rows)
        starts, ends, row = starts[~special], ends[~special], row[~special]
        hashes, size = Hashes(data), ends - starts
        h = hashes.of(starts, ends)
        back, first = identity(hashes, h, starts, size)
        h, s, size = h[first], starts[first], size[first]
        tokens = np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        met = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        met[met] = self.length[at[met]] == size[met]
        met[met] = hashes.alike(s[met], size[met], self.chars, self.place[at[met]])
        tokens[met] = self.counts[at[met]]
        new = np.flatnonzero(~met)
        if len(new):
            tokens[new] = self.merge(self.byte_id[data[spread(s[new], size[new])]], size[new])
            self._remember(h, tokens, new[: max(0, REMEMBERED - len(self.known))], data, s, size)
        return total + np.bincount(row, weights=tokens[back], minlength=rows).astype(np.int64)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_bytes (UTF-8) and n_tokens. ``tokenizer``: a byte-level BPE .json that every worker can read."""
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([picked.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch, data, offs in blocks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(vocab.count(data, offs))], names=[id_col, "n_bytes", "n_tokens"])

    return picked.mapInArrow(run, schema)
