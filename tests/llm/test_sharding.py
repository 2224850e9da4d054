import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from paralens.llm import sharding as s


def check(out, docs, tolerance):
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    held = [[r for r in rows if r.shard == k] for k in range(16)]
    for h in held:
        assert sorted(r.slot for r in h) == list(range(len(h)))
    sums = [sum(r.size for r in h) for h in held]
    assert max(sums) - min(sums) <= tolerance * sum(sums) / 16 + 2 * sorted(r.size for r in rows)[len(rows) // 2]


@pytest.mark.parametrize("scale", ["even", "rising", "clustered", "one_key"])
def test_shards_are_even_and_gapless(spark, scale):
    key = {"even": "id", "rising": "id * id", "clustered": "CASE WHEN id % 3 = 0 THEN 7 * id ELSE 1000000000 + id END", "one_key": "CASE WHEN id % 3 = 0 THEN 5 ELSE id END"}[scale]
    docs = spark.range(4000).selectExpr(f"{key} AS doc_id", "concat('t', id, repeat('x', cast(id * 7919 % 97 AS INT))) AS text")
    check(s.shard(docs), docs, 0.03)


def hashed(key, text):
    """Spark's xxhash64(seed, key, text), nulls left out."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", s.SEED), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, shards=16, ranges=256):
    """The module's rules over sorted lists: {row number: (size, shard, slot)}."""
    table = [(s.SMALLEST if k is None else k, hashed(k, t), len((t or "").encode()) + 1, n) for n, (k, t) in enumerate(rows)]
    total = sum(size for *_, size, _ in table)
    heavy = [r for r in table if r[2] * s.HEAVY * shards > total]
    light = [r for r in table if r[2] * s.HEAVY * shards <= total]
    unit = lambda tie: (tie % (1 << 40)) / (1 << 40)
    drawn = sorted(key for key, tie, size, _ in light if unit(tie) < size * (ranges * s.SAMPLE_PER_RANGE / total))
    bounds = sorted({drawn[max(0, math.ceil(k / ranges * len(drawn)) - 1)] for k in range(1, ranges)}) if drawn else []
    target = min(-(-total // ranges), s.CELL_BYTES)
    of_range = lambda key: sum(b < key for b in bounds)
    held = Counter()
    for key, _, size, _ in light:
        held[of_range(key)] += size
    ways = {r: math.ceil(b / target) if b > 2 * target else 1 for r, b in held.items()}
    line = sorted((of_range(key), tie % ways[of_range(key)], key, tie, size, n) for key, tie, size, n in light)
    out, loads, counts = {}, [0] * shards, [0] * shards
    for rank, (_, _, size, n) in enumerate(sorted(heavy, key=lambda r: (-r[2], r[0], r[1]))):
        turn = rank % shards
        shard = turn if rank // shards % 2 == 0 else shards - 1 - turn
        out[n] = (size, shard, counts[shard])
        loads[shard] += size
        counts[shard] += 1
    room, at = s.water_level(loads, total - sum(loads)), 0
    ends = [sum(room[: k + 1]) for k in range(shards - 1)]
    for *_, size, n in line:
        shard = sum(at + size / 2 >= e for e in ends)
        out[n] = (size, shard, counts[shard])
        counts[shard] += 1
        at += size
    return out


@pytest.mark.parametrize("cell", [s.CELL_BYTES, 300])
def test_equals_brute_force(spark, docs, texts, cell, monkeypatch):
    monkeypatch.setattr(s, "CELL_BYTES", cell)
    rows = [*enumerate(texts), *((9, f"hot key {k}") for k in range(400)), (None, "no id"), (77, None), *((1000 + k, "y" * (3000 if k % 40 == 0 else 30)) for k in range(200))]
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, nth int")
    assert {r.nth: (r["size"], r.shard, r.slot) for r in s.shard(df).collect()} == brute(rows)


def test_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(s, "MANY_EQUAL", 500)
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE concat('text ', id) END AS text")
    out = s.shard(docs)
    check(out, docs, 0.03)
    assert out.where("doc_id = 5").groupBy("shard").count().count() >= 5 and set(out.columns) == {"doc_id", "text", "size", "shard", "slot"}


def test_a_few_large_texts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', CASE WHEN id % 500 = 3 THEN 9000 ELSE 40 END) AS text")
    check(s.shard(docs), docs, 0.03)


def test_same_rows_same_shards(docs):
    place = lambda d: {r.doc_id: (r.shard, r.slot) for r in s.shard(d).collect()}
    assert place(docs) == place(docs.repartition(6))


def test_water_level():
    assert s.water_level([0, 0, 10], 20) == [10, 10, 0] and s.water_level([0, 0, 100], 20) == [10, 10, 0] and s.water_level([3, 1], 0) == [0, 0]


def test_odd_rows(odd, none):
    out = s.shard(odd)
    check(out, odd, 10)
    assert out.where("text IS NULL AND size <> 1").count() == 0 and set(out.columns) == {*odd.columns, "shard", "slot"}
    assert s.shard(none).count() == 0
    assert s.shard(odd.where(F.col("doc_id").isNull())).count() == 1
