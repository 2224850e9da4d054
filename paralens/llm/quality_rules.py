"""Quality rules as a bitmask ledger.

``measure`` reads every text once. ``ledger`` evaluates every rule once on the measurements and
keeps one failure bit a rule. Policies are masks over those bits: applying a version, or finding
what each rule costs, is bitwise arithmetic on the stored ledger and never touches the texts again.

Equal lines and windows are found by hash and compared by bytes. Null texts have no words; a null id is kept as it is; repeated rows are measured one by one; an
empty table gives an empty ledger. Only the id and text columns are read, so other columns can
have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import CODE_POINT, SPACED_WORD, Hashes, blocks, byte_table, covered, in_row, lines, per_row, runs, windows

SYMBOLS = byte_table([(ord(c), ord(c)) for c in "#*$%&|<>"])
REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements; ``bit`` never changes once given out."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("v1", ("few_words", "repeated_words", "symbols")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def _repeated(key: np.ndarray, row: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], text: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal an earlier one of their row, and which any other one. ``key``: hashes with the row; ``same``: of pairs, whether they are equal.

    Equal neighbours by hash are compared; should any differ, items go by their bytes.
    """
    later, several = np.zeros(len(key), bool), np.zeros(len(key), bool)
    order = np.argsort(key, kind="stable")
    pair = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[pair], order[pair + 1]
    if ((row[a] == row[b]) & same(a, b)).all():
        later[b] = several[a] = several[b] = True
        return later, several
    first: dict[tuple[int, bytes], int] = {}
    for k in np.unique(np.concatenate([a, b])).tolist():
        at = first.setdefault((int(row[k]), text(k)), k)
        if at != k:
            later[k] = several[k] = several[at] = True
    return later, several


def _block(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    word = SPACED_WORD[data]
    starts, ends, row = runs(word, offs)
    hashes = Hashes(data)
    words = np.bincount(row, minlength=n)

    l_starts, l_ends, l_row = lines(data, offs)
    total = np.concatenate([[0], np.cumsum(word, dtype=np.int64)])
    full = total[l_ends] > total[l_starts]
    l_starts, l_ends, l_row = l_starts[full], l_ends[full], l_row[full]
    size = l_ends - l_starts
    alike = lambda a, b: (size[a] == size[b]) & hashes.alike(l_starts[a], np.minimum(size[a], size[b]), hashes, l_starts[b])
    later, _ = _repeated(in_row(hashes.of(l_starts, l_ends), l_row), l_row, alike, lambda k: hashes.text(int(l_starts[k]), int(size[k])))
    dup_lines = np.bincount(l_row[later], minlength=n)

    key, at = windows(hashes.of(starts, ends), row, REPEAT_WINDOW)
    length = ends - starts

    def alike_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for k in range(REPEAT_WINDOW):
            x, y = at[a] + k, at[b] + k
            out &= (length[x] == length[y]) & hashes.alike(starts[x], np.minimum(length[x], length[y]), hashes, starts[y])
        return out

    spaced = lambda k: b" ".join(hashes.text(int(starts[j]), int(length[j])) for j in range(at[k], at[k] + REPEAT_WINDOW))
    _, several = _repeated(in_row(key, row[at]), row[at], alike_words, spaced)
    found = at[several]
    hit = covered(found, found + REPEAT_WINDOW, len(row))
    repeat = np.bincount(row[hit], minlength=n)
    return [words, per_row(word & CODE_POINT[data], offs), per_row(SYMBOLS[data], offs), per_row(data == 10, offs) + 1, dup_lines, repeat]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and MEASURES.

    n_words counts ``[^ \\t-\\r]+``; word_chars their code points; n_symbols the characters of
    ``#*$%&|<>``; n_dup_lines lines with a word that equal an earlier line; n_repeat_words words in
    windows of five that the text has twice or more, the first included.
    """
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([picked.schema[0], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "__text"):
            columns = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in _block(data, offs))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *MEASURES])

    return picked.mapInArrow(run, schema)


def ledger(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with ``fail_bits``: bit k is set if the rule of bit k fails."""
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measures.withColumn("fail_bits", bits)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[name] for name in policy.rules)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(stored: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, that fail it alone, and that the policy keeps with and without it."""
    named = {r.name: r for r in rules}
    cells = F.array(*(F.struct(F.lit(p.version).alias("policy"), F.lit(name).alias("rule"), F.lit(mask(p, rules)).cast("long").alias("mask"), F.lit(1 << named[name].bit).cast("long").alias("rule_bit")) for p in policies for name in p.rules))
    counted = stored.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))  # at most one row a bit pattern
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    alone = failed == F.col("rule_bit")
    return (
        counted.select("fail_bits", "n", F.inline(cells))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(failed.bitwiseAND(F.col("rule_bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when((failed == 0) | alone, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
