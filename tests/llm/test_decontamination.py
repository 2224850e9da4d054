import gc
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from paralens.llm import decontamination as d
from paralens.llm import ragged
from paralens.store import Table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, size=8):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def items(texts):
    shared = next(t for t in texts if "last line" in t)
    return [(0, shared), (1, texts[0][:120]), (2, "of"), (3, ""), (4, None), (5, "not there at all in any way whatever"), (1, "the of"), (None, texts[5])]


@pytest.mark.parametrize("block", [d.BLOCK_WINDOWS, 20])
def test_equals_brute_force(spark, docs, texts, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in d.contamination(docs, bench, block_windows=block).collect()}
    expected = brute(texts, [x for x in items if x[0] is not None])
    assert [found[k] for k in range(len(texts))] == expected and any(e[1] for e in expected)


@pytest.mark.parametrize("block", [d.BLOCK_WINDOWS, 1])
def test_rows_of_one_item_count_once(spark, block):
    docs = spark.createDataFrame([(1, "a b c d and e f g h"), (2, "e f g h"), (3, "k l m n a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (5, "e f g h"), (6, "k l m n")], "item_id long, text string")
    found = {r.doc_id: sorted(r["items"]) for r in d.contamination(docs, bench, 4, block_windows=block).collect()}
    assert found == {1: [5], 2: [5], 3: [5, 6]}


def test_index_serves_any_benchmark(docs, texts, items):
    q = d.query_block([x for x in items if x[0] is not None and x[1]], 8)
    found = {r.id: sorted(set(r["items"])) for r in d.search(d.build_index(docs), q).collect()}
    assert [found[k] for k in range(len(texts))] == [e[2] for e in brute(texts, [x for x in items if x[0] is not None])]


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} is in item {k} and nowhere else") for k in range(5)], "doc_id long, text string")
    alive, most = [], []
    made = d.query_block

    def block(items, size):
        gc.collect()
        most.append(sum(r() is not None for r in alive))
        q = made(items, size)
        alive.append(weakref.ref(q))
        return q

    monkeypatch.setattr(d, "query_block", block)
    bench = spark.createDataFrame([(k, f"word{k} is in item") for k in range(5)], "item_id long, text string").coalesce(1)
    found = {r.doc_id: r["items"] for r in d.contamination(docs, bench, 4, block_windows=1).collect()}
    assert found == {k: [k] for k in range(5)} and len(alive) == 5 and max(most) <= 1


@pytest.mark.parametrize("collide", [False, True])
def test_words_are_told_apart_by_bytes(spark, thue_morse, collide, monkeypatch):
    if collide:
        monkeypatch.setattr(ragged.Hashes, "of", lambda self, a, b: np.full(len(a), 7, np.uint64))
    a, b = thue_morse
    docs = [(1, a), (2, b), (3, f"{a} {b}"), (4, "x y")]
    bench = [(7, a), (8, b), (9, "y")]
    q = d.query_block(bench, 8)
    (row,) = [r for batch in _segments(docs) for r in batch.to_pylist()]
    s = d.Segment(*(row[c] for c in ("n_words", "terms", "chars", "char_ends", "ends", "positions")))
    w, first, _ = s.phrases(q)
    assert sorted(zip(s.doc_of(first).tolist(), q.item[w].tolist(), strict=True)) == [(0, 0), (1, 1), (2, 0), (2, 1), (3, 2)]


def _segments(docs):
    """What the index's tasks make of these documents."""

    class Docs:
        def select(self, *_):
            return self

        schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("__text", T.StringType())])

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["__id", "__text"])
            return list(run(iter([batch])))

    context = d.TaskContext
    d.TaskContext = type("", (), {"get": staticmethod(lambda: type("", (), {"partitionId": staticmethod(lambda: 0)}))})
    try:
        return d.build_index(Docs())
    finally:
        d.TaskContext = context


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x b"), (4, "a"), (5, "b")], "doc_id long, text string")
    found = d.search(d.build_index(docs), d.query_block([(7, "a b")], 2), slop=3)
    assert {r.id for r in found.collect() if r["items"]} == {1, 2}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string")
    rows = d.contamination(odd, bench).collect()
    assert len(rows) == odd.count() and sum(r.n_hit == 3 for r in rows) == 3
    assert d.contamination(none, bench).count() == 0
    empty = d.contamination(odd, bench.where("item_id > 5")).collect()
    assert len(empty) == odd.count() and all(r.n_hit == 0 for r in empty)


def test_texts_go_to_workers_in_small_batches(spark):
    docs = spark.range(0, 12_000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 300) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    seen = Table(docs.mapInArrow(sizes, "size long"), "sizes", batch_mb=d.BATCH_MB).df.collect()
    assert sum(r.size for r in seen) > 2 * max(r.size for r in seen) and max(r.size for r in seen) < 1.1 * d.BATCH_MB * 2**20


def test_index_and_search_take_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(key)

    class Watched(Table):
        def __init__(self, df, label, *a, **k):
            seen[label] = k.get("batch_mb")
            super().__init__(df, label, *a, **k)

    monkeypatch.setattr(d, "Table", Watched)
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c d e f g h i")], "item_id long, text string")
    assert d.contamination(docs, items).first().n_hit == 8
    assert seen == {"postings": d.BATCH_MB, "matches": d.BATCH_MB} and spark.conf.get(key) == before
