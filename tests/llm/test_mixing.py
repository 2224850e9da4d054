import math

import pytest
from pyspark.sql import functions as F

from paralens.llm import mixing as m


def sized(spark, shares, docs=40):
    return spark.createDataFrame([(k * 1000 + d, s, n) for k, (s, n) in enumerate(shares.items()) for d in range(docs)], "doc_id long, source string, n_tokens long")


SHARES = {"a": 100, "b": 10, "c": 10, "d": 5}


def entropy(w):
    return -sum(x * math.log(x) for x in w if x)


def test_reaches_the_target_entropy(spark):
    rows = m.weights(sized(spark, SHARES), target_entropy=0.9, max_repeats=100).collect()
    assert entropy([r.weight for r in rows]) == pytest.approx(0.9 * math.log(4), rel=1e-6) and sum(r.weight for r in rows) == pytest.approx(1)


def test_keeps_to_the_repetition_limit(spark):
    rows = m.weights(sized(spark, SHARES), target_entropy=1.0, max_repeats=1.5).collect()
    assert max(r.quota / r.held for r in rows) == pytest.approx(1.5, rel=1e-3)


@pytest.mark.parametrize("budget", [0.3, 1.0, 2.5])
def test_realises_the_quotas_in_blocks(spark, budget):
    docs = sized(spark, SHARES)
    plan = m.weights(docs, budget=budget, max_repeats=100)
    mixed = m.mix(docs, plan, block_tokens=500).cache()
    taken = {r.source: (r.n, r.most) for r in mixed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect()}
    for p in plan.collect():
        n, most = taken[p.source]
        assert p.quota <= n < p.quota + most + 1
    passes = mixed.groupBy("doc_id").agg(F.count("*").alias("n")).join(docs, "doc_id").groupBy("source").agg((F.max("n") - F.min("n")).alias("d")).collect()
    assert all(r.d <= 1 for r in passes)
    share = mixed.groupBy("block").pivot("source").sum("n_tokens").orderBy("block").collect()[:-1]
    assert all(abs(r["a"] - share[0]["a"]) <= 200 for r in share)
    assert mixed.orderBy("doc_id", "epoch").collect() == m.mix(docs.repartition(7), plan, block_tokens=500).orderBy("doc_id", "epoch").collect()


@pytest.mark.parametrize("options", [{}, {"target_entropy": 0.9, "max_repeats": 100}, {"max_repeats": 1.2}, {"budget": m.COVER, "target_entropy": None, "max_repeats": 2.0}, {"budget": 2.5}])
def test_many_sources_are_planned_alike(spark, monkeypatch, options):
    docs = sized(spark, {**SHARES, "none": 0})
    plain = m.weights(docs, **options).orderBy("source").collect()
    monkeypatch.setattr(m, "MAX_BROADCAST", 3)
    for a, b in zip(plain, m.weights(docs, **options).orderBy("source").collect(), strict=True):
        assert (a.source, a.quota, a.whole, a.rest) == (b.source, b.quota, b.whole, b.rest) and a.weight == pytest.approx(b.weight)


def test_more_windows_for_larger_sources(spark, monkeypatch):
    docs = sized(spark, SHARES)
    plan = m.weights(docs)
    plain = m.mix(docs, plan).orderBy("doc_id", "epoch").collect()
    monkeypatch.setattr(m, "BUCKET_DIGITS", 0)
    monkeypatch.setattr(m, "BUCKET_ROWS", 3)
    assert plain == m.mix(docs, plan).orderBy("doc_id", "epoch").collect()


def test_cover_takes_everything_at_least_once(spark):
    docs = sized(spark, SHARES)
    n = {r.doc_id: r["count"] for r in m.mix(docs, m.weights(docs, budget=m.COVER, target_entropy=None, max_repeats=2.0)).groupBy("doc_id").count().collect()}
    assert len(n) == docs.count() and set(n.values()) <= {1, 2} and 2 in n.values()


def test_odd_rows(odd, none):
    docs = odd.withColumn("n_tokens", m.n_words(F.col("text"))).withColumn("rest", F.lit("mine"))
    mixed = m.mix(docs, m.weights(docs, budget=m.COVER, target_entropy=None, max_repeats=2.0))
    assert set(mixed.columns) == {*docs.columns, "block"} and mixed.where("n_tokens = 0").count() >= 4 and mixed.where("rest = 'mine'").count() >= odd.count()
    empty = none.withColumn("n_tokens", m.n_words(F.col("text")))
    assert m.mix(empty, m.weights(empty)).count() == 0
