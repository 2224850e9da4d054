"""Resampling and inference on the wording by item matrix, in long form (p, i, c).

Random orders come from md5 digests of seed, repetition and keys, with the key as tie-break, so a
result depends neither on partitioning nor on the engine. Orders within a repetition are taken in
cells of the digest's leading digits once a repetition outgrows a window, and whatever can be is an
aggregate with map-side combining.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..store import written
from .draws import holds, rank_products
from .ordered import running

#: Rows of one group that one window sorts.
WINDOW_ROWS = 1_000_000
#: Distinct values whose ranks are sent to every executor, 30 bytes each.
BROADCAST_RANKS = 1_000_000
#: Rows whose products of doubled ranks, 4 n^2 at most, a long holds the sum of.
LONG_SUMS = 1_300_000
#: Rows that repetitions move at once where a task can't draw them alone.
MOVED_ROWS = 10_000_000

def order_key(*parts: object) -> Column:
    """A reproducible pseudo-random key."""
    return F.md5(F.concat_ws("|", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts)))


def shuffled(df: DataFrame, by: list[str], digest: Column, tie: str, rows: int, out: str = "nth") -> DataFrame:
    """The rows with their place in each group along a random order. ``rows``: how many the largest group has, at most.

    A digest's leading digits cut large groups into even cells, whose sizes say what lies before each.
    """
    digits = 0
    while rows > WINDOW_ROWS * 16**digits:
        digits += 1
    drawn = df.withColumn("__digest", digest)
    if not digits:
        return drawn.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("__digest", tie))).drop("__digest")
    drawn = drawn.withColumn("__cell", F.substring("__digest", 1, digits))
    sizes = drawn.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select(*by, "__cell", (F.sum("__n").over(along) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__digest", tie))
    return drawn.withColumn("__nth", nth).join(before, [*by, "__cell"]).withColumn(out, F.col("__before") + F.col("__nth")).drop("__digest", "__cell", "__n", "__nth", "__before")


def complete(cells: DataFrame, n_items: int) -> DataFrame:
    """Cells of wordings that have all items."""
    full = cells.groupBy("p").agg(F.count_distinct("i").alias("n")).where(F.col("n") == n_items).select("p")
    return cells.join(full, "p", "left_semi")


def item_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("i").agg(F.sum("c").cast("long").alias("l"))


def _margins(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row each: k, sum and squares over wordings; b, sum and squares over items."""
    g = cells.groupBy("p").agg(F.sum("c").cast("long").alias("g"))
    rows = g.agg(F.count(F.lit(1)).alias("k"), F.sum("g").alias("sum_g"), F.sum(F.col("g") * F.col("g")).alias("squares_g"))
    columns = item_totals(cells).agg(F.count(F.lit(1)).alias("b"), F.sum("l").alias("sum_l"), F.sum(F.col("l") * F.col("l")).alias("squares_l"))
    return rows, columns


def _q(k: Column, sum_g: Column, squares_g: Column, sum_l: Column, squares_l: Column) -> Column:
    """In whole numbers up to the last division; null with fewer than two wordings or if no item tells them apart."""
    top = (k - 1) * (k * squares_g - sum_g * sum_g)
    return F.when(k >= 2, F.try_divide(top.cast("double"), (k * sum_l - squares_l).cast("double")))


def cochran_q(cells: DataFrame) -> DataFrame:
    """One row: k wordings, b items and Cochran's Q."""
    rows, columns = _margins(cells)
    c = F.col
    return rows.join(F.broadcast(columns)).select("k", "b", _q(c("k"), c("sum_g"), c("squares_g"), c("sum_l"), c("squares_l")).alias("q"))


def permutation_null(cells: DataFrame, reps: int = 1000, seed: int = fixed.SEED_PERMUTATION) -> DataFrame:
    """A row a repetition: q, sd and range when each item keeps its number of correct wordings and chance says which."""
    cells = written(cells.select("p", "i", "c"), "cells")  # read once a table, not once a branch
    _, columns = _margins(cells)
    totals = cells.groupBy("i").agg(F.sum("c").cast("long").alias("l"), F.count(F.lit(1)).alias("n"))
    most = totals.agg(F.max("n")).first()[0] or 0
    drawn = cells.select("p", "i").join(totals.drop("n"), "i").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    placed = shuffled(drawn, ["rep", "i"], order_key(seed, F.col("rep"), F.col("i"), F.col("p")), "p", most)
    g = placed.select("rep", "p", (F.col("nth") <= F.col("l")).cast("long").alias("c")).groupBy("rep", "p").agg(F.sum("c").alias("g"))
    c = F.col
    by_rep = g.groupBy("rep").agg(
        F.count(F.lit(1)).alias("k"), F.sum("g").alias("sum_g"), F.sum(c("g") * c("g")).alias("squares_g"), F.max("g").alias("most"), F.min("g").alias("least")
    )
    by_rep = by_rep.join(F.broadcast(columns))
    # The deviation in whole numbers up to the root: k * squares - sum^2 over (k * b)^2.
    spread = F.sqrt((c("k") * c("squares_g") - c("sum_g") * c("sum_g")).cast("double")) / (c("k") * c("b")).cast("double")
    q = F.coalesce(_q(c("k"), c("sum_g"), c("squares_g"), c("sum_l"), c("squares_l")), F.lit(0.0))
    return by_rep.select("rep", q.alias("q"), spread.alias("sd"), ((c("most") - c("least")) / c("b").cast("double")).alias("range"))


def upper_p(observed: Column, null: Column) -> Column:
    """Aggregate: one-sided p of the observed value, which itself counts as one draw. Values that differ by rounding alone are equal."""
    return F.when(F.max(observed).isNotNull(), (F.count_if(null >= observed - F.abs(observed) * 1e-12) + 1) / (F.count(F.lit(1)) + 1).cast("double"))


def spread_test(cells: DataFrame, reps: int = 1000, seed: int = fixed.SEED_PERMUTATION) -> DataFrame:
    """One row: Q, deviation and range of the accuracies against their permutation null."""
    cells = written(cells.select("p", "i", "c"), "cells")
    rows, columns = _margins(cells)
    c = F.col
    limits = cells.groupBy("p").agg(F.sum("c").cast("long").alias("g")).agg(F.max("g").alias("most"), F.min("g").alias("least"))
    seen = rows.join(F.broadcast(columns)).join(F.broadcast(limits)).select(
        "k", "b", _q(c("k"), c("sum_g"), c("squares_g"), c("sum_l"), c("squares_l")).alias("oq"),
        (F.sqrt((c("k") * c("squares_g") - c("sum_g") * c("sum_g")).cast("double")) / (c("k") * c("b")).cast("double")).alias("osd"),
        ((c("most") - c("least")) / c("b").cast("double")).alias("orange"),
    )
    drawn = permutation_null(cells, reps, seed).join(F.broadcast(seen))
    return drawn.agg(
        F.max("k").alias("k_wordings"), F.max("b").alias("b_items"), F.max("oq").alias("cochran_q"), upper_p(c("oq"), c("q")).alias("q_p_value"),
        F.max("osd").alias("observed_sd"), F.avg("sd").alias("null_sd_mean"), F.percentile("sd", 0.95).alias("null_sd_p95"), upper_p(c("osd"), c("sd")).alias("sd_p_value"),
        F.max("orange").alias("observed_range"), F.avg("range").alias("null_range_mean"), F.percentile("range", 0.95).alias("null_range_p95"),
        upper_p(c("orange"), c("range")).alias("range_p_value"), F.count(F.lit(1)).alias("permutations"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: the correlation; null for fewer than three pairs or a constant side."""
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def split_halves(cells: DataFrame, reps: int = 200, seed: int = fixed.SEED_SPLIT) -> DataFrame:
    """A row a split that has one: rep, r between the wordings' totals on two random halves of the items, and its Spearman-Brown correction. An odd item is left out."""
    items = cells.select("i").distinct()
    drawn = items.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    by_rep = Window.partitionBy("rep")
    nth = F.row_number().over(by_rep.orderBy(order_key(seed, F.col("rep"), F.col("i")), "i"))
    halves = drawn.select("rep", "i", nth.alias("nth"), F.floor(F.count(F.lit(1)).over(by_rep) / 2).alias("size"))
    halves = halves.select("rep", "i", F.when(F.col("nth") <= F.col("size"), "a").when(F.col("nth") <= 2 * F.col("size"), "b").alias("half")).where("half IS NOT NULL")
    scored = cells.join(halves, "i").groupBy("rep", "p").agg(F.sum(F.when(F.col("half") == "a", F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("half") == "b", F.col("c")).otherwise(0)).alias("b"))
    n, a, b = F.count(F.lit(1)), F.col("a").cast("long"), F.col("b").cast("long")
    # Products of totals are whole numbers, so constant halves are found exactly.
    sums = scored.groupBy("rep").agg(n.alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    c = F.col
    top = c("n") * c("ab") - c("sa") * c("sb")
    below = [(c("n") * c(f"{x}{x}") - c(f"s{x}") * c(f"s{x}")).cast("double") for x in "ab"]
    r = F.when(c("n") >= 3, F.try_divide(top.cast("double"), F.sqrt(below[0]) * F.sqrt(below[1])))
    out = sums.select("rep", r.alias("r")).where("r IS NOT NULL")
    return out.withColumn("corrected", F.when(F.col("r") > -1, 2 * F.col("r") / (1 + F.col("r"))))


def split_half_reliability(cells: DataFrame, reps: int = 200, seed: int = fixed.SEED_SPLIT) -> DataFrame:
    """One row: splits that have a correlation, its mean, and the mean of the corrected ones."""
    return split_halves(cells, reps, seed).agg(F.count(F.lit(1)).alias("splits"), F.avg("r").alias("half_correlation"), F.avg("corrected").alias("spearman_brown"))


def ranked(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """The rows with twice their average rank (a whole number; equals share one) within ``by``. Only distinct values are ordered.

    ``df`` is read twice: pass a stored table.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running(counts, by, value, "__n", "__upto").select(*by, value, (2 * F.col("__upto") - F.col("__n") + 1).cast("long").alias(out))
    ranks = written(ranks, "ranks")
    few = ranks.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS
    return df.join(F.broadcast(ranks) if few else ranks, [*by, value])


def rank_pairs(long: DataFrame) -> DataFrame:
    """(p, ord, name, x, y) with doubled ranks rx and ry in each feature, stored."""
    long = written(long, "features")
    return written(ranked(ranked(long, "x", ["name"], "rx"), "y", ["name"], "ry"), "feature-ranks")


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _sum_of_products(x: Column, y: Column) -> Column:
    """Aggregate: in whole numbers that hold the sum whatever the number of rows; one product fits a long."""
    return F.sum((x * y).cast("decimal(20,0)"))


def _covariance(n: Column, xy: Column, x: Column, y: Column) -> Column:
    return (_whole(n) * xy - _whole(x) * y).cast("decimal(38,0)")


def spearman(pairs: DataFrame) -> DataFrame:
    """A row a feature: ord, name, n, rho (null if either side is constant), from ``rank_pairs``."""
    c = F.col
    sums = pairs.groupBy("ord", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"),
        _sum_of_products(c("rx"), c("ry")).alias("xy"), _sum_of_products(c("rx"), c("rx")).alias("xx"), _sum_of_products(c("ry"), c("ry")).alias("yy"),
    )
    part = lambda both, a, b: _covariance(c("n"), c(both), c(a), c(b)).cast("double")
    rho = F.when(c("n") >= 3, F.try_divide(part("xy", "sx", "sy"), F.sqrt(part("xx", "sx", "sx")) * F.sqrt(part("yy", "sy", "sy"))))
    return sums.select("ord", "name", "n", rho.alias("rho"), _covariance(c("n"), c("xy"), c("sx"), c("sy")).alias("cov"), "sx", "sy")


def _products_of_moved(wide: DataFrame, orders: list[int], reps: range, seed: int, rows: int) -> DataFrame:
    """(rep, ord, xy) by shuffling a copy of all wordings a repetition."""
    drawn = wide.select("p", "ry").withColumn("rep", F.explode(F.sequence(F.lit(reps[0]), F.lit(reps[-1]))))
    placed = shuffled(drawn, ["rep"], order_key(seed, F.col("rep"), F.col("p")), "p", rows)
    # The accuracy drawn as k-th goes to the k-th wording by id.
    moved = placed.select("rep", F.col("nth").alias("at"), F.col("ry").alias("other")).join(wide.drop("p", "ry", "one"), "at")
    total = _sum_of_products if rows > LONG_SUMS else lambda x, y: F.sum(x * y)
    sums = moved.groupBy("rep").agg(*(total(F.col(f"rx{k}"), F.col("other")).alias(f"xy{k}") for k in orders))
    return sums.select("rep", F.inline(F.array(*(F.struct(F.lit(k).alias("ord"), F.col(f"xy{k}").alias("xy")) for k in orders))))


def spearman_permutation_p(pairs: DataFrame, reps: int = 2000, seed: int = fixed.SEED_SPEARMAN) -> DataFrame:
    """A row a feature: ord, name, rho and its two-sided permutation p; null where rho is.

    Ranks don't change under permutation, so only the sum of their products is taken again, in whole
    numbers, from one shuffle of the wordings a repetition that all features share. Up to WINDOW_ROWS
    wordings a task draws whole repetitions from its own copy of the ranks. More are moved, MOVED_ROWS
    or a repetition at a time, so that the disk holds no more.
    """
    spark, c = pairs.sparkSession, F.col
    own = written(spearman(pairs), "correlations")  # a row a feature
    orders = sorted(r[0] for r in own.select("ord").collect())
    rx = [F.max(F.when(F.col("ord") == k, F.col("rx"))).alias(f"rx{k}") for k in orders]
    wide = running(pairs.groupBy("p").agg(F.min_by("ry", "ord").alias("ry"), *rx).withColumn("one", F.lit(1)), [], "p", "one", "at")
    wide = written(wide, "ranks-by-wording")
    rows, most = wide.agg(F.count(F.lit(1)), F.max(F.greatest("ry", "ry", *(f"rx{k}" for k in orders)))).first()

    def hits(products: DataFrame) -> DataFrame:
        beyond = F.abs(_covariance(c("n"), c("xy"), c("sx"), c("sy"))) >= F.abs(c("cov"))
        return products.join(F.broadcast(own), "ord").groupBy("ord", "name").agg(F.max("rho").alias("rho"), F.count_if(beyond).alias("hits"))

    if not rows:
        seen = own.select("ord", "name", "rho", F.lit(0).alias("hits"))
    elif rows <= min(WINDOW_ROWS, LONG_SUMS) and holds(rows, most):
        seen = hits(rank_products(wide, orders, reps, seed, most))
    else:
        step, found = max(1, MOVED_ROWS // rows), []
        for first in range(0, reps, step):
            found += hits(_products_of_moved(wide, orders, range(first, min(first + step, reps)), seed, rows)).select("ord", "hits").collect()
            gc.collect()
            spark.sparkContext._jvm.System.gc()  # else shuffle files stay until the driver happens to collect its garbage
        counts = spark.createDataFrame([(k, sum(r.hits for r in found if r.ord == k)) for k in orders], "ord int, hits long")
        seen = counts.join(F.broadcast(own), "ord").select("ord", "name", "rho", "hits")
    return seen.select("ord", "name", "rho", F.when(c("rho").isNotNull(), (c("hits") + 1) / F.lit(float(reps + 1))).alias("p"))


def holm(tests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (ord, name, p) with ``p_holm``. Null p are no tests and stay null."""
    known = tests.where("p IS NOT NULL")
    group = Window.partitionBy(*(by or [F.lit(0)]))
    rising = group.orderBy("p", "ord")
    left = F.count(F.lit(1)).over(group) - F.row_number().over(rising) + 1
    stepped = known.withColumn("__step", F.least(F.lit(1.0), left * F.col("p")))
    held = stepped.withColumn("p_holm", F.max("__step").over(rising.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")
    return held.unionByName(tests.where("p IS NULL").withColumn("p_holm", F.lit(None).cast("double")))


def feature_table(long: DataFrame, reps: int = 2000, seed: int = fixed.SEED_SPEARMAN) -> DataFrame:
    """A row a feature of (p, ord, name, x, y): ord, name, rho, p, p_holm, share_with_feature.

    A constant feature is a test with p = 1; with constant accuracies nothing is a test.
    """
    pairs = rank_pairs(long)
    tested = spearman_permutation_p(pairs, reps, seed)
    kinds = pairs.groupBy("name").agg(
        F.count_distinct("x").alias("values"), F.min("y").alias("low"), F.max("y").alias("high"),
        F.when(F.bool_and(F.col("x").isin(0.0, 1.0)), F.avg("x")).alias("share_with_feature"),
    )
    p = F.when(F.col("low") == F.col("high"), None).when(F.col("values") < 2, F.lit(1.0)).otherwise(F.col("p"))
    rows = tested.join(F.broadcast(kinds), "name").select("ord", "name", "rho", p.alias("p"), "share_with_feature")
    return holm(rows)
