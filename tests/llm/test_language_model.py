import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paralens.llm import language_model as lm
from paralens.llm import ragged
from paralens.llm.log_bilinear import Network, Shape, Tokens
from paralens.llm.queries import held_out


@pytest.fixture(scope="module")
def scored(docs):
    return {r.doc_id: r for r in lm.score(docs, held_out(2, 7)).collect()}


def tokens(text):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)), None]


def test_base_equals_brute_force(scored, texts):
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    c = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for k, t in enumerate(texts):
        r, w = scored[k], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))


def contexts(shape, n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, shape.contexts, n), rng.integers(0, shape.contexts, n)


def test_network_is_normalised():
    shape = Shape(50, 7, 5)
    net = Network.fresh(shape, np.full(shape.outputs, 1 / shape.outputs), np.full(50, 1 / 50), 1)
    net.p["output_bias"][:] = np.random.default_rng(2).normal(0, 1, shape.outputs)
    one, two = contexts(shape, 40)
    total = np.zeros(40)
    for word in range(50):
        total += np.exp(net.log_probabilities(Tokens(np.full(40, word % 7), np.full(40, word), one, two)))
    for output in range(7, shape.outputs):
        total += np.exp(net.log_probabilities(Tokens(np.full(40, output), np.full(40, -1), one, two)))
    assert np.allclose(total, 1, atol=1e-5)


def test_network_learns_what_follows_what():
    """Two kinds of contexts, each with words of its own: their entropy is nearly reached."""
    rng, shape = np.random.default_rng(3), Shape(40, 6, 5)
    kind = rng.integers(0, 2, 60_000)
    word = rng.integers(0, 20, 60_000) + 20 * kind
    tokens = Tokens(word % 6, word, rng.integers(0, 20, 60_000) + 20 * kind, rng.integers(0, shape.contexts, 60_000))
    outputs, words = np.bincount(word % 6, minlength=shape.outputs) + 1.0, np.bincount(word, minlength=40) + 1.0
    net = Network.fresh(shape, outputs / outputs.sum(), words / words.sum(), 1)
    for k in range(4):
        net.learn(tokens, outputs / outputs.sum(), words / words.sum(), np.random.default_rng(k))
    assert -net.log_probabilities(tokens).mean() < np.log(20) + 0.1  # log(40) knows no contexts


def test_words_and_one_unseen_share_each_tail_class_exactly():
    h = np.arange(1, 501, dtype=np.uint64)
    kind, often = (h % np.uint64(lm.TAILS)).astype(np.int64), np.concatenate([np.arange(200, 0, -1), np.ones(200, int), np.full(100, 2)])
    once, twice = (int((often == k).sum()) for k in (1, 2))
    sums = lm.Sums(
        np.array([often.sum(), 500, once, twice]), np.bincount(kind, weights=often, minlength=lm.TAILS), np.bincount(kind, minlength=lm.TAILS), h[:60], np.zeros(60, np.int64), often[:60], kind[:60]
    )
    assert all(np.array_equal(x, y) for x, y in zip(vars(lm.Sums.unpack(sums.pack())).values(), vars(sums).values(), strict=True))
    classes = lm.Classes(sums)
    assert classes.words(h, np.zeros(500, np.uint32)).tolist() == [*range(60), *[-1] * 440] and (classes.words(h, np.ones(500, np.uint32)) == -1).all()
    for k in range(lm.TAILS):
        mine = np.flatnonzero((kind == k) & (np.arange(500) >= 60))
        p = np.exp(classes.within_tail(np.append(often[mine], 0).astype(float), np.full(len(mine) + 1, k)))
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_beats_shares_alone_on_held_out_text(spark):
    scored = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), held_out(2, 7))
    n, base, model = scored.where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert model / n > base / n + 0.4


def test_what_is_learnt_grows():
    assert [lm.heads_of(n) for n in (10**5, 10**7, 10**9)] == [800, 5047, 31848]


def test_tokens_are_told_apart_by_two_hashes(spark, thue_morse):
    a, b = thue_morse
    docs = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x")], "doc_id long, text string")
    found = {r.doc_id: (r.n_known, r.held_out) for r in lm.score(docs, F.col("doc_id") == 2).collect()}
    assert found == {1: (3, False), 2: (2, True)}
    first, index = lm.distinct(np.array([5, 5, 3, 5], np.uint64), np.array([1, 2, 1, 1], np.uint32))
    assert len(first) == 3 and index[0] == index[3] != index[1]


def test_base_does_not_depend_on_partitions(docs, scored, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 50)
    again = {r.doc_id: r for r in lm.score(docs.repartition(5), held_out(2, 7)).collect()}
    assert all(again[k].base_score == pytest.approx(r.base_score) and again[k].n_known == r.n_known for k, r in scored.items())


def test_odd_rows(odd, none):
    rows = lm.score(odd, held_out(2, 7)).collect()
    assert len(rows) == odd.count() and all(r.score < 0 for r in rows) and sum(r.n_tokens == 1 for r in rows) == 4
    assert lm.score(none, held_out(2, 7)).count() == 0
    assert all(r.train_tokens == 0 for r in lm.score(odd, F.lit(True)).collect())


def many_words(n, seed=5):
    rng = np.random.default_rng(seed)
    return [" ".join(f"word{k}" for k in rng.zipf(1.3, n // 8) % 50_000) for _ in range(8)]


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_chunks_are_stored_in_small_row_groups(spark):
    """What a task holds of its chunks does not grow with its file."""
    texts = many_words(2_000_000)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(3 * texts)], "doc_id long, text string").coalesce(1)
    [path] = [f.removeprefix("file://") for f in lm.stored(docs, F.lit(False), "doc_id", "text").inputFiles()]
    meta = pq.ParquetFile(path).metadata
    sizes = [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    assert sum(sizes) > 24 << 20 and max(sizes) < 16 << 20


def test_tokenising_holds_no_sums_over_whole_chunks():
    texts = [t.encode() for t in many_words(400_000)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ragged._powers.clear()
    assert peak(lambda: lm._chunk(data, offs, np.ones(len(texts), bool))) < 35 * len(data)


def test_scoring_holds_no_scores_of_many_contexts():
    shape = Shape(2000, 90, 96)
    net, n = Network.fresh(shape, np.full(shape.outputs, 1 / shape.outputs), np.full(2000, 1 / 2000), 1), 100_000
    word = np.random.default_rng(1).integers(0, 2000, n)
    tokens = Tokens(word % 90, word, *contexts(shape, n))
    assert peak(lambda: net.log_probabilities(tokens)) < 160 * n


def test_hashes_of_words_are_those_of_ranges():
    for text in (b"a bb  ccc abcdefgh abcdefghi " * 40 + b"x" * 30, b"x" * 500 + b" y", b"", b"word"):
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = ragged.runs(ragged.SPACED_WORD[data], np.array([0, len(data)]))
        for salt, h in enumerate(ragged.word_hashes(data, starts, ends, (0, 1))):
            assert np.array_equal(h, ragged.Hashes(data, salt).of(starts, ends))
