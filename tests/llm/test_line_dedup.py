import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from paralens.llm import line_dedup as d


def brute(rows):
    """By neighbouring lines alone: where each two lines hold a word, chunks of more lines remove nothing else."""
    first, out = {}, {}
    for i, t in sorted(rows):
        parts, gone, at = t.encode().split(b"\n"), set(), 0
        for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)):
            if re.search(rb"[^\x20\x09-\x0D]", x + y) and first.setdefault((x, y), (i, at)) != (i, at):
                gone |= {k, k + 1}
            at += len(x) + 1
        out[i] = (len(parts), len(gone), hashlib.sha256(b"\n".join(p for k, p in enumerate(parts) if k not in gone)).hexdigest())
    return out


def test_equals_brute_force(docs, texts):
    found = {r.doc_id: (r.n_lines, r.n_removed_lines, r.kept_sha256) for r in d.dedup(docs).collect()}
    assert found == brute(list(enumerate(texts))) and any(f[1] for f in found.values())


def test_boundaries_resist_shifts():
    passage = [f"line {k} of a passage" for k in range(30)]
    cut = lambda rows: (lambda raw, x: {raw[a:b] for a, b, n in zip(x.begin, x.stop, x.last - x.first, strict=True) if n > 1})(raw := "\n".join(rows).encode(), d.Lines(np.array([0]), np.frombuffer(raw, np.uint8), np.array([len(raw)])))
    a, b = cut(passage), cut(["something", "else", "before", *passage, "and after"])
    assert len(a & b) >= len(a) - 2 and len(a) > 2


@pytest.mark.parametrize("size", range(2, 11))
def test_short_passages_between_other_lines(spark, size):
    """The later copy of a passage goes whole, and nothing around it."""
    rows, kept = [], {}
    for k in range(12):
        passage = [f"passage {k} line {j}" for j in range(size)]
        for i in (k, 50 + k):
            around = [[f"text {i} line {j} {side}" for j in range(k % 4)] for side in "ab"]
            rows.append((i, "\n".join([*around[0], *passage, *around[1]])))
            kept[i] = "\n".join([*around[0], *(passage if i < 50 else []), *around[1]])
    found = d.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in found} == kept
    assert all(r.n_removed_lines == (size if r.doc_id >= 50 else 0) for r in found)


def test_blocks_are_told_apart_by_bytes(spark, thue_morse):
    a, b = thue_morse
    rows = [(1, f"{a}\n{a}"), (2, f"{b}\n{b}"), (3, f"{b}\n{b}\nend")]
    assert {r.doc_id: bytes(r.kept).decode() for r in d.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: rows[0][1], 2: rows[1][1], 3: "end"}
    x = d.Lines(np.array([0]), np.frombuffer(b"p q\nr s\np q\nr s", np.uint8), np.array([15]))
    x.one = np.full(len(x.one), 7)  # blocks that share one hash
    first, times = x.distinct()
    assert x.find(x.one[first], x.two[first]).tolist() == [[y for y in range(len(first)) if x.two[first[y]] == t][0] for t in x.two] and sorted(times.tolist()) == [1, 1, 2]


def test_a_block_of_every_document(spark):
    rows = [(k, f"own {k}\nshared line one\nshared line two\nthe end {k}") for k in range(3000)]
    found = d.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).agg(F.sum("n_removed_lines"), F.count("*")).first()
    assert tuple(found) == (2 * 2999, 3000)


def test_odd_rows(odd, none):
    rows = d.dedup(odd).collect()
    assert len(rows) == odd.count() and all(r.n_lines == 1 for r in rows)
    assert d.dedup(none).count() == 0


def test_texts_are_cut_without_counts_of_every_byte():
    rows = [f"line {k % 997} of a text that goes on for a while" for k in range(20_000)]
    raw = "\n".join(rows).encode()
    x = d.Lines(np.array([0, 1]), np.frombuffer(raw + raw, np.uint8), np.array([len(raw), len(raw)]))
    gone = np.arange(len(x.row)) % 7 == 0
    tracemalloc.start()
    try:
        texts = x.without(gone)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts[0] == "\n".join(r for k, r in enumerate(rows) if k % 7).encode() and texts[1] == "\n".join(r for k, r in enumerate(rows) if (k + 20_000) % 7).encode()
    assert peak < 12 * len(x.data)
