import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paralens.llm import quality_classifier as q
from paralens.llm.queries import op10_quality_classifier
from paralens.llm.ragged import flat


def test_features_are_present_ngrams():
    texts = ["abcd abcd abcd", "", "xyz"]
    row, feature = q.features(*flat(pa.array(texts)))
    assert (np.diff(row) >= 0).all() and (np.bincount(row, minlength=3)[1:] == 1).all()
    grams = {"abcd abcd abcd"[k : k + 4].encode() for k in range(11)}
    assert (row == 0).sum() == 1 + len(grams) + 2 + 1  # the constant, the n-grams, equal neighbours once and twice, and one over a gap


def test_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(1, 60, 12)) for _ in range(120)]
    y = np.where(np.array([(r < 30).mean() for r in rows]) > 0.5, 1, -1)
    values = [np.ones(len(r)) / np.sqrt(len(r)) for r in rows]
    w = q.dual_coordinate_descent(rows, values, y, epochs=400, tolerance=1e-5)
    loss = lambda w: w @ w / 2 + sum(max(0, 1 - c * float(w[r] @ v)) for r, v, c in zip(rows, values, y, strict=True))
    best = loss(w)
    for _ in range(200):
        d = np.zeros_like(w)
        d[:60] = rng.normal(0, 0.02, 60)
        assert loss(w + d) >= best - 1e-3


def test_descent_over_parts_solves_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(1, 60, 12)) for _ in range(120)]
    y = np.where(np.array([(r < 30).mean() for r in rows]) > 0.5, 1, -1)
    values = [np.ones(len(r)) / np.sqrt(len(r)) for r in rows]
    whole = q.dual_coordinate_descent(rows, values, y, epochs=400, tolerance=1e-6)
    cuts = [(a, min(a + 17, 120)) for a in range(0, 120, 17)]
    parts = q.block_descent([y[a:b] for a, b in cuts], lambda k: (rows[slice(*cuts[k])], values[slice(*cuts[k])]), epochs=400, tolerance=1e-6)
    np.testing.assert_allclose(parts, whole, atol=1e-3)


def test_no_row_is_left_out_however_few_indicators_are_held(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    fit_parts = q.fit_parts

    def counted(parts, rows_of):
        seen.append((len(parts), sorted((int(label), tuple(r.tolist())) for k, p in enumerate(parts) for label, r in zip(p, rows_of(k), strict=True))))
        return fit_parts(parts, rows_of)

    monkeypatch.setattr(q, "fit_parts", counted)
    one, many = q.train(docs, labels), q.train(docs, labels, part_features=20_000)
    assert seen[0][0] == 1 and seen[1][0] > 3 and seen[0][1] == seen[1][1]
    assert len(seen[0][1]) == labels.where("quality IN (0, 1)").select("doc_id").distinct().count()
    np.testing.assert_array_equal(one.squares, many.squares)
    column = flat(pa.array([r.text for r in docs.orderBy("doc_id").collect()]))
    assert ((one.scores(*column) >= 0.5) == (many.scores(*column) >= 0.5)).mean() > 0.98


def test_repeated_rows_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "good words"), (2, "bad ones"), (3, None), (4, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, quality int")
    a, b = q.train(docs, labels), q.train(docs.unionAll(docs.limit(3)), labels.unionAll(labels))
    np.testing.assert_array_equal(a.weights, b.weights)
    assert (a.slope, a.shift) == (b.slope, b.shift)


def test_held_out_accuracy(spark):
    scored = op10_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right = scored.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


@pytest.mark.parametrize(("labels", "expected"), [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_too_few_labels(labels, expected):
    model = q.fit([np.array([0, 5])] * len(labels), np.array(labels, int))
    assert model.scores(*flat(pa.array(["a", ""]))).tolist() == [expected] * 2


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)] + [(None, 1), (2, None)], "doc_id long, quality int")
    model = q.train(odd, labels)
    rows = q.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert q.score(none, model).count() == 0 and q.train(none, labels.limit(0)).constant == 0.5
    kept = q.score(odd, model, carry=("size", "fp"), keep_text=True)
    assert kept.columns == ["doc_id", "size", "fp", "text", "score"] and kept.where("text IS NULL").count() == odd.where("text IS NULL").count()
