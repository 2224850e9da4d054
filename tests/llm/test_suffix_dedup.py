import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from paralens.llm import suffix_dedup as s
from paralens.llm.ragged import covered


def brute(rows, span=50):
    first = {}
    for i, t in sorted(rows):
        for k in range(len(t) - span + 1):
            first.setdefault(t[k : k + span], i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < i:
                gone[k : k + span] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_equals_brute_force(docs, texts):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(docs).collect()}
    assert found == brute([(k, t.encode()) for k, t in enumerate(texts)]) and sum(f[1] > 0 for f in found.values()) > 20


def test_edges_of_matches(spark):
    """Matches of 49, 50 and 51 bytes, at the ends of texts, overlapping and in periodic text."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = [(5, base), (9, "XX" + base[10:59] + "YY"), (7, "ZZ" + base[10:60]), (8, base[100:151] + "Q" + base[120:200]), (6, "ab" * 200), (10, "b" + "ab" * 60), (11, base[:40]), (1, base[200:260])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(df).collect()} == brute([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("seed", range(8))
def test_run_length_index(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 40))]
    ids = np.array([rng.randint(0, 20) for _ in strings])
    sizes = np.array([len(x) for x in strings])
    found = s.earlier_windows(np.frombuffer(b"".join(strings), np.uint8), sizes, ids, 8)
    expected = [len(x) - p >= 8 and any(x[p : p + 8] in y and j < i for y, j in zip(strings, ids, strict=True)) for x, i in zip(strings, ids, strict=True) for p in range(len(x))]
    assert found.tolist() == expected


def test_every_window_has_its_anchor():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offs = np.array([0, 30, 30, 1200, 5000])
    at, first, last = s.anchors(data, offs)
    seen = np.zeros(5000, int)
    for a, b, c in zip(at, first, last, strict=True):
        assert b <= a and a + s.GRAM <= b + s.SPAN and c <= a
        seen[b : c + 1] += 1
    row = np.repeat(np.arange(4), np.diff(offs))
    assert [seen[k] == 1 for k in range(4951)] == [row[k] == row[k + 49] for k in range(4951)]


def one_anchor(n, seed=2):
    """Texts of 84 bytes around one gram, which is the anchor of (almost) all their windows."""
    rng = np.random.default_rng(seed)
    grams = rng.integers(97, 123, (200_000, s.GRAM)).astype(np.uint8)
    word = np.ascontiguousarray(grams).view("<u8")
    h = (word[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (word[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    left = s.SPAN - s.GRAM
    every = rng.integers(97, 123, (n, left + s.SPAN)).astype(np.uint8)
    every[:, left : s.SPAN] = grams[np.argmin(h * np.uint64(0x94D049BB133111EB))]
    return every


def digest(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(df).collect()}


def test_many_contexts_of_one_anchor(spark):
    """Of 300,000 texts that share 16 bytes, none goes."""
    every = one_anchor(300_000)
    df = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(every)), "text": [x.tobytes().decode() for x in every]})).repartition(8)
    assert s.dedup(df).where("n_removed > 0").count() == 0


@pytest.mark.parametrize("hot", [s.HOT, 3])
def test_windows_of_hot_anchors(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "PORTION", 200)
    monkeypatch.setattr(s, "BUCKET_ANCHORS", 60)
    rows = [(k, t.encode()) for k, t in enumerate(texts)]
    assert digest(docs) == brute(rows)
    base = one_anchor(30)
    mixed = [(k, x.tobytes()) for k, x in enumerate(base)] + [(100 + k, base[k, 5:60].tobytes() + base[k + 1, :70].tobytes()) for k in range(20)] + [(150, base[0].tobytes() * 3)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in mixed], "doc_id long, text string")
    assert digest(df) == brute(mixed)


def test_rows_never_outnumber_entries():
    data = np.random.default_rng(3).integers(97, 123, 60_000).astype(np.uint8)
    chunk = s.Chunk(np.arange(60), data, np.full(60, 1000), None)
    entries = chunk.contexts()
    for buckets in (1, 32, 1 << 20, 1 << 31):
        batch = entries.deal(0, buckets)
        assert batch.num_rows <= min(buckets, len(chunk.at))
        assert sum(len(x) for x in batch.column(3).to_pylist()) == 8 * len(entries.one)


def test_odd_rows(odd, none):
    rows = s.dedup(odd).collect()
    assert len(rows) == odd.count() and sum(r.n_removed == r.n_bytes > 0 for r in rows) == 1  # the second long text
    assert s.dedup(none).count() == 0


def test_chunks_without_hot_anchors_hash_no_windows(monkeypatch):
    text = np.frombuffer(b"some words that stand here and nowhere else, so that nothing repeats at all 0123456789", np.uint8)
    c = s.Chunk(np.array([1]), text, np.array([len(text)]), None)
    monkeypatch.setattr(s, "Hashes", None)
    start, windows = c.windows(np.zeros(0, np.int64), 50)
    assert len(start) == len(windows.later) == len(windows.one) == 0


def test_stretches_are_the_positions_covered():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 300):
        a = rng.integers(0, 900, n)
        b = a + rng.integers(1, 40, n)
        low, high = s.merged(a, b)
        assert np.array_equal(s.marked(low, high, 1000), covered(a, b, 1000)) and (low[1:] > high[:-1]).all()


def test_order_keeps_equal_hashes_together():
    rng = np.random.default_rng(5)
    group, one, two = (rng.integers(0, 4, 500).astype(t) for t in (np.uint32, np.uint64, np.uint32))
    order, fresh = s.ordered((group.astype(np.uint64) << np.uint64(32)) | (one >> np.uint64(32)), group, one, two)
    triples = list(zip(group[order].tolist(), one[order].tolist(), two[order].tolist(), strict=True))
    assert fresh.sum() == len(set(triples)) and [t for t, f in zip(triples, fresh, strict=True) if f] == sorted(set(triples))


@pytest.mark.parametrize("sizes", [[0, 200, 0, 0, 60, 49, 50, 1, 300, 0], [40, 40, 40], [0, 60], [60, 0], [33_000, 70]])
def test_anchors_stay_within_texts(sizes):
    data, offs = np.random.default_rng(6).integers(97, 100, sum(sizes)).astype(np.uint8), np.cumsum([0, *sizes])
    at, first, last = s.anchors(data, offs)
    windows = [k for a, b in zip(offs, offs[1:], strict=False) for k in range(a, b - 49)]
    assert [k for a, b in zip(first, last, strict=True) for k in range(a, b + 1)] == windows
    row = np.searchsorted(offs, at, "right") - 1
    assert (offs[row] <= first).all() and (last + 50 <= offs[row + 1]).all() and (last <= at).all() and (at + 16 <= first + 50).all()
