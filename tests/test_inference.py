import hashlib
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from paralens.operators import accounting, describe, draws, inference, ordered


def cells(spark, matrix):
    return spark.createDataFrame([(p, i, int(c)) for p, row in enumerate(matrix) for i, c in enumerate(row)], "p int, i int, c int")


def world(seed, effect, k=60, b=24):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.15, 0.85, b)[None, :] + (rng.uniform(-0.35, 0.35, k)[:, None] if effect else 0)
    return rng.random((k, b)) < np.clip(p, 0.02, 0.98)


@pytest.mark.parametrize(("matrix", "q"), [
    ([[1, 0, 0, 1], [0, 1, 1, 0], [1, 1, 0, 0], [0, 0, 1, 1]], 0.0), ([[1] * 4, [1] * 4, [0] * 4, [0] * 4], 12.0), ([[1, 0, 1]] * 10, None), ([[1, 0]], None),
])
def test_cochran(spark, matrix, q):
    assert inference.cochran_q(cells(spark, matrix)).first().q == q


def test_null_world_shows_no_effect_and_real_world_does(spark):
    null = inference.spread_test(cells(spark, world(1, False)), 100).first()
    real = inference.spread_test(cells(spark, world(2, True)), 100).first()
    assert null.q_p_value > 0.05 and real.q_p_value < 0.02 and real.sd_p_value < 0.02 and null.permutations == 100


def test_null_keeps_item_totals_and_expectations(spark):
    m = world(3, True, 30, 8)
    df = cells(spark, m)
    drawn = inference.permutation_null(df, 400).agg(F.avg("q").alias("q"), F.avg(F.col("sd") ** 2).alias("v")).first()
    k, b, l = 30, 8, m.sum(0)
    assert drawn.q == pytest.approx(k - 1, rel=0.05)
    assert drawn.v == pytest.approx(float((l * (k - l)).sum()) / (k * k * b * b), rel=0.05)


def test_reliability(spark):
    real, null = (inference.split_half_reliability(cells(spark, world(s, e)), 60).first() for s, e in ((4, True), (5, False)))
    assert real.spearman_brown > 0.6 and abs(null.spearman_brown) < 0.4 and real.splits == 60
    assert inference.split_half_reliability(cells(spark, [[1, 1]] * 5), 10).first().splits == 0


def test_incomplete_wordings_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 1)], "p int, i int, c int")
    assert {r.p for r in inference.complete(df, 2).collect()} == {1}


def test_description(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    d = describe.describe(df, "x").first()
    assert (d.n, d.median, d.p25, d.min, d.max, d.range) == (4, 2.5, 1.75, 1, 4, 3)
    assert describe.describe(df.where("x < 2"), "x").first().sd == 0.0
    e = describe.describe(df.where("x > 9"), "x").first()
    assert e.n == 0 and all(e[m] is None for m in describe.MEASURES[1:])


def test_histogram_clamps_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.5, 0.999, 1.0, -3.0, 7.0)], "x double")
    n = [r.n for r in describe.histogram(df, "x", bins=10).orderBy("bin").collect()]
    assert n == [3, 0, 0, 0, 0, 1, 0, 0, 0, 3]


def test_holm(spark):
    df = spark.createDataFrame([(0, "a", 0.02), (1, "b", 0.001), (2, "c", 0.5), (3, "d", 0.04), (4, "e", None)], "ord int, name string, p double")
    assert {r.name: r.p_holm for r in inference.holm(df).collect()} == {"a": pytest.approx(0.06), "b": pytest.approx(0.004), "c": 0.5, "d": pytest.approx(0.08), "e": None}


def test_spearman(spark):
    rows = [(p, o, n, x, float(p * p)) for p in range(20) for o, n, x in ((0, "up", float(p)), (1, "flat", 1.0), (2, "down", -float(p // 2)))]
    long = spark.createDataFrame(rows, "p int, ord int, name string, x double, y double")
    rho = {r["name"]: r.rho for r in inference.spearman(inference.rank_pairs(long)).collect()}
    assert rho["up"] == pytest.approx(1.0) and rho["flat"] is None and rho["down"] < -0.99
    t = {r["name"]: r for r in inference.feature_table(long, 50).collect()}
    assert t["up"].p == pytest.approx(1 / 51) and t["flat"].p == 1.0 and t["flat"].rho is None


def test_spearman_of_many_wordings(spark):
    long = spark.range(60_000).selectExpr("id AS p", "0 AS ord", "'x' AS name", "double(id) AS x", "double(id * 7919 % 60000) AS y")
    row = inference.spearman(inference.rank_pairs(long)).first()
    y = [p * 7919 % 60_000 for p in range(60_000)]
    assert (row.n, row.rho) == (60_000, pytest.approx(1 - 6 * sum((p - q) ** 2 for p, q in enumerate(y)) / (60_000 * (60_000**2 - 1))))


def test_sums_of_ranks_products_hold_more_than_a_long(spark):
    ranks = [(2 * 10**9 + 7 * k, 2 * 10**9 + k * k) for k in range(9)]
    row = inference.spearman(spark.createDataFrame([(0, "x", x, y) for x, y in ranks], "ord int, name string, rx long, ry long")).first()
    assert row["cov"] == 9 * sum(x * y for x, y in ranks) - sum(x for x, _ in ranks) * sum(y for _, y in ranks)


def test_permutations_of_many_wordings(spark):
    long = spark.range(60_000).selectExpr("id AS p", "0 AS ord", "'x' AS name", "double(id) AS x", "double(id div 7) AS y")
    assert inference.spearman_permutation_p(inference.rank_pairs(long), 3).first().p == 1 / 4


def test_permutations_of_sums_beyond_a_long(spark, monkeypatch):
    monkeypatch.setattr(inference, "LONG_SUMS", 0, raising=False)
    p = lambda least: inference.spearman_permutation_p(spark.createDataFrame([(k, 0, "x", least + 7 * k, least + k * 5 % 9) for k in range(9)], "p long, ord int, name string, rx long, ry long"), 40).first().p
    assert p(2 * 10**9) == p(0) and 0 < p(0) < 1


def test_feature_table_of_many_wordings(spark):
    long = spark.range(60_000).selectExpr("id AS p", "double(id div 7) AS y", "inline(array(named_struct('ord', 0, 'name', 'rising', 'x', double(id)), named_struct('ord', 1, 'name', 'flat', 'x', 1D)))")
    t = {r["name"]: r for r in inference.feature_table(long, 3).collect()}
    assert (t["rising"].p, t["rising"].p_holm) == (1 / 4, 1 / 2) and (t["flat"].rho, t["flat"].p, t["flat"].share_with_feature) == (None, 1.0, 1.0)


def test_permutations_move_no_rows_or_some_at_a_time(spark, monkeypatch):
    long = spark.range(500).selectExpr("concat('w', id * 37) AS p", "double(id * 7 % 11) AS y", "inline(array(named_struct('ord', 0, 'name', 'up', 'x', double(id % 90)), named_struct('ord', 2, 'name', 'some', 'x', double(id % 7 = 0)))) ")
    pairs = inference.rank_pairs(long)
    ps = lambda: {r["name"]: (r.ord, r.p) for r in inference.spearman_permutation_p(pairs, 30).collect()}
    moved, some = [], inference._products_of_moved
    monkeypatch.setattr(inference, "_products_of_moved", lambda wide, orders, reps, *a: moved.append(list(reps)) or some(wide, orders, reps, *a))
    here = ps()
    assert not moved and all(0 < p <= 1 for _, p in here.values())
    monkeypatch.setattr(inference, "WINDOW_ROWS", 400)
    monkeypatch.setattr(inference, "MOVED_ROWS", 6000)
    assert ps() == here and moved == [list(range(k, min(k + 12, 30))) for k in (0, 12, 24)]


def test_digests_and_sums_of_drawn_orders():
    for keys in ([b"|%d" % k for k in range(0, 40_000, 7)], [b"", b"|x" * 40, "|\u00e9".encode(), b"|" + b"y" * 52], [b"|" + b"z" * 50]):
        data, offs = np.frombuffer(b"".join(keys), np.uint8), np.cumsum([0, *map(len, keys)])
        for beginning in (b"3|0", b"3|12", b"3|1999", b""):
            whole = [hashlib.md5(beginning + k).digest() for k in keys]
            high, low = draws.Keys(data, offs).digests(beginning)
            assert [a.to_bytes(8) + b.to_bytes(8) for a, b in zip(high.tolist(), low.tolist(), strict=True)] == whole
            order = draws.Keys(data, offs).order(beginning)
            assert order.tolist() == sorted(range(len(keys)), key=whole.__getitem__)
        most = min(int((2**63 / len(keys)) ** 0.5), 2**26) - 1  # a double holds the sum of few products
        assert draws.holds(len(keys), most)
        ry, rx = [most - k for k in range(len(keys))], [most - 3 * k for k in range(len(keys))]
        ranks = draws.Ranks(data, offs, np.array(ry, np.int32), np.array([rx, ry], np.int32), most)
        other = [ry[k] for k in draws.Keys(data, offs).order(b"5|8")]
        assert ranks.products(5, [7, 8])[1].tolist() == [sum(a * b for a, b in zip(x, other, strict=True)) for x in (rx, ry)]


def test_equal_leading_digits_are_told_apart_by_the_others(monkeypatch):
    high, low = np.array([5, 3, 5, 3, 5], np.uint64), np.array([9, 7, 2, 7, 9], np.uint64)
    monkeypatch.setattr(draws.Keys, "digests", lambda *_: (high, low))
    assert draws.Keys(np.empty(0, np.uint8), np.zeros(6, np.int64)).order(b"").tolist() == [1, 3, 2, 0, 4]


def test_constant_accuracy_is_no_finding(spark):
    long = spark.createDataFrame([(p, 0, "x", float(p), 1.0) for p in range(9)], "p int, ord int, name string, x double, y double")
    row = inference.feature_table(long, 20).first()
    assert row.rho is None and row.p is None and row.p_holm is None


def test_ties_of_best_and_worst_go_to_the_smallest_id(spark):
    df = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.1), (0, 0.1), (4, None)], "p long, strict_accuracy double")
    r = accounting.best_and_worst(df).first()
    assert (r.best, r.worst) == (1, 0)


def test_canonical_without_a_grade_is_null(spark):
    df = spark.createDataFrame([(3, 0.5), (1, 0.7)], "p long, strict_accuracy double")
    r = accounting.canonical_rank(df, df).first()
    assert r.canonical_accuracy is None and r.canonical_percentile is None


def test_places_across_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x", "id % 3 AS g")
    rows = ordered.numbered(df, ["x"], "nth").collect()
    assert all(r.nth == r.x + 1 for r in rows) and len(rows) == 1000
    sums = {(r.g, r.x): r.upto for r in ordered.running(df, ["g"], "x", "x", "upto").collect()}
    for g in range(3):
        xs = sorted(x for h, x in sums if h == g)
        assert [sums[g, x] for x in xs] == list(accumulate(xs))


def test_random_orders_in_cells_are_the_same(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS p", "id % 2 AS g")
    digest = inference.order_key(1, F.col("p"))
    plain = {(r.p, r.nth) for r in inference.shuffled(df, ["g"], digest, "p", 150).collect()}
    monkeypatch.setattr(inference, "WINDOW_ROWS", 5)
    assert plain == {(r.p, r.nth) for r in inference.shuffled(df, ["g"], digest, "p", 150).collect()}


def test_order_statistics_of_continuous_columns(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2, 2)] + [(None, 7.0), ("b", None)], "g string, x double")
    few, many = ({r.g: r for r in f(df, "x", ["g"]).collect()} for f in (describe.describe, describe.describe_continuous))
    assert few == many and many[None].median == 7.0 and many["b"].n == 0 and many["a"].p25 == 2.0
    assert describe.describe(df, "x").first() == describe.describe_continuous(df, "x").first()
    empty = describe.describe_continuous(df.where("g = 'z'"), "x").first()
    assert empty.n == 0 and empty.median is None
