import re

import numpy as np
import pytest
import xxhash

from paralens.llm import near_dedup as n
from paralens.llm.ragged import Ranges


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def fingerprint(text, k):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, radius=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [min(ids[j] for j in range(len(fps)) if label[j] == x) for x in label]


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(docs, texts, k):
    rows = {r.doc_id: (r.fp % 2**64, r.component_id) for r in n.near_duplicates(docs, k).collect()}
    fps = [fingerprint(t, k) for t in texts]
    assert [rows[i][0] for i in range(len(texts))] == fps
    assert [rows[i][1] for i in range(len(texts))] == components(fps, list(range(len(texts))))


@pytest.mark.parametrize("part", [n.PART, 8])
def test_dense_balls_and_chains(spark, monkeypatch, part):
    """Many fingerprints near few centres, so that buckets are large and are split."""
    monkeypatch.setattr(n, "PART", part)
    monkeypatch.setattr(n, "SHOWN", 1 if part == 8 else n.SHOWN)
    rng = np.random.default_rng(2)
    fps = set()
    for centre in rng.integers(0, 2**63, 6).tolist():
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    tree = n.components(n.links(spark.createDataFrame(signed, "fp long"))).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in tree}
    expected = components(fps, fps)
    same = lambda labels: {frozenset(f for f, x in zip(fps, labels, strict=True) if x == y) for y in set(labels)}
    assert same([root.get(f, f) for f in fps]) == same(expected)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    refs = n.pivots()
    assert np.abs(n.pivot_table(a, refs) - n.pivot_table(b, refs)).max() <= 4


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    assert {(r.node, r.root) for r in n.components(edges).collect()} == {(k, 0) for k in range(1, 301)} | {(1001, 1000)}


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 9000, dtype=np.uint8)
    size = np.concatenate([np.arange(200), rng.integers(0, 5000, 200), [n.LONG, n.LONG + 1]])
    starts = rng.integers(0, 9000 - size + 1)
    found = n.xxh64(Ranges(data), starts, size)
    assert found.tolist() == [xxhash.xxh64_intdigest(data[a : a + k].tobytes(), 42) for a, k in zip(starts, size, strict=True)]


def test_hot_fingerprints_are_joined_alike(spark, docs, monkeypatch):
    plain = sorted(map(tuple, n.near_duplicates(docs, 4).collect()))
    monkeypatch.setattr(n, "HOT", 40)
    assert plain == sorted(map(tuple, n.near_duplicates(docs, 4).collect()))


def test_odd_rows(odd, none):
    rows = n.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.fp == 0} == {0}
    assert n.near_duplicates(none).count() == 0
