import random

import numpy as np
import pytest
from test_near_dedup import fingerprint
from test_near_dedup import words as split

from paralens.llm import near_dedup, similar_texts


def shingles(text):
    w = split(text)
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(ids, texts):
    """Smallest id of each text's group, over all pairs."""
    sets, fps = [shingles(t) for t in texts], [fingerprint(t, 5) for t in texts]
    label = list(range(len(texts)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * either or (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    low = {}
    for k, i in enumerate(ids):
        low[top(k)] = min(i, low.get(top(k), i))
    return [low[top(k)] for k in range(len(ids))]


def edited(n=240, seed=4):
    """Texts and copies of them with one to six words changed."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    out = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        if k % 2 and out:
            text = rng.choice(out).split()
            for _ in range(rng.randint(1, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("part", [near_dedup.PART, 4])
def test_keeps_one_of_each_group(spark, texts, monkeypatch, part):
    if part == 4:
        monkeypatch.setattr(near_dedup, "PART", part)
        monkeypatch.setattr(near_dedup, "SHOWN", 1)
        monkeypatch.setattr(near_dedup, "HOT", 20)
        monkeypatch.setattr(similar_texts, "PART_SHINGLES", 150)
    every = [*texts, *edited()]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    expected = groups(range(len(every)), every)
    assert len(set(expected)) < len({fingerprint(t, 5) for t in every})
    assert sorted(r.doc_id for r in similar_texts.keep_one(docs).collect()) == sorted(set(expected))


def test_texts_with_looped_passages(spark):
    """Sets of 0.8 and more whose fingerprints are far apart, as one text repeats a passage."""
    rng = random.Random(7)
    draw = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    texts = []
    for plain, looped, times in [(300, 40, 20), (200, 40, 10), (100, 30, 5)] * 4:
        a, b = draw(plain), draw(looped)
        texts += [" ".join(a + b), " ".join([*a[:50], "changed", *a[51:], *b * times])]
    fps = [fingerprint(t, 5) for t in texts]
    assert max((x ^ y).bit_count() for x, y in zip(fps[::2], fps[1::2], strict=True)) > 20
    expected = sorted(set(groups(range(len(texts)), texts)))
    assert expected == list(range(0, len(texts), 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar_texts.keep_one(docs).collect()) == expected


@pytest.mark.parametrize("n", [5, 60, 400, 3000])
def test_bounds_keep_every_similar_pair(n):
    """Against all pairs of sets around the limit."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    sets = [np.unique(np.concatenate([base[: n - k], rng.integers(0, 1 << 32, m, dtype=np.uint32)])) for k in range(0, n // 4 + 1, max(1, n // 40)) for m in (0, n // 20, n // 9, n // 5)]
    for x in range(len(sets)):
        for y in range(x):
            two = [sets[x], sets[y]]
            held, offs = np.concatenate(two), np.array([0, len(two[0]), len(two[0]) + len(two[1])])
            a, _ = similar_texts.similar(np.arange(2), held, offs)
            both = len(np.intersect1d(*two))
            assert bool(a) == (5 * both >= 4 * (offs[2] - both))


def test_a_bucket_gives_a_forest_of_its_links():
    sets = [np.arange(k, k + 100, dtype=np.uint32) for k in range(0, 60, 5)]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    a, b = similar_texts.similar(np.arange(len(sets)), np.concatenate(sets), offs)
    assert sum(len(x) for x in a) == len(sets) - 1
    a, b = similar_texts.similar(np.arange(len(sets)) // 4, np.concatenate(sets), offs)
    assert sum(len(x) for x in a) == 2  # of three components
    far = np.concatenate([np.arange(100), np.arange(12, 112)]).astype(np.uint32)
    assert similar_texts.similar(np.arange(2), far, np.array([0, 100, 200])) == ([], [])


def test_ids_decide_nothing_but_which_row_stays(spark):
    """Different texts without an id, or of one id, all stay; near and equal ones go once, and before those with an id."""
    rng = random.Random(9)
    one, two, three, four = ([f"w{rng.randrange(100_000)}" for _ in range(120)] for _ in range(4))
    join, near = " ".join, lambda w: " ".join([*w[:-1], "changed"])
    rows = [(None, join(one)), (None, join(two)), (None, join(two)), (None, near(two)), (None, near(three)), (7, join(three)), (None, None), (5, join(four)), (5, "other text " * 5), (5, join(four)), (6, near(four))]
    kept = [(r.doc_id, r.text) for r in similar_texts.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    assert len(kept) == 6 and {(None, join(one)), (7, join(three)), (None, None), (5, join(four)), (5, "other text " * 5)} < set(kept)
    assert (None, join(two)) in kept or (None, near(two)) in kept


def test_recall_against_all_pairs(spark):
    """Of a hundredth of the documents against all of them, at most a tenth of the similar pairs may share no bucket; here none is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sets = {r.doc_id: shingles(r.text) for r in docs}
    table = spark.createDataFrame(docs)
    keys = {r.doc_id: set(r["keys"]) for r in similar_texts.profiles(table).collect()}
    found = lost = 0
    for i in sets:
        for j in sets if i % 100 == 0 else ():
            both = len(sets[i] & sets[j])
            if i != j and both and 5 * both >= 4 * len(sets[i] | sets[j]):
                found += 1
                lost += not keys[i] & keys[j]
    assert lost <= found / 10
    kept = {r.doc_id for r in similar_texts.keep_one(table).collect()}
    label = groups(list(sets), [r.text for r in docs]) if len(docs) <= 1000 else []
    assert len(kept ^ set(label)) <= len(set(label)) / 100


def test_odd_rows(odd, none):
    kept = similar_texts.keep_one(odd)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == odd.columns
    # No words at all (with the smallest id), "a b c", and the long text.
    assert sorted((i, (t or "")[:5]) for i, t in rows) == [(0, ""), (0, "a b c"), (3, "w0 w1")]
    assert similar_texts.keep_one(none).count() == 0


def test_rows_alike_but_for_other_columns(spark):
    rows = [(1, "some text", "b"), (1, "some text", "a"), (1, "some text", "c")]
    assert [tuple(r) for r in similar_texts.keep_one(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()] == [(1, "some text", "a")]


def test_one_word_of_many_megabytes(spark):
    docs = spark.createDataFrame([(1, "x" * 20_000_000), (2, "x" * 20_000_000), (3, "y " * 3_000_000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar_texts.keep_one(docs).select("doc_id").collect()) == [1, 3]
