"""Exact descriptive statistics; null where there is nothing to describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
MEASURES = ("n", "mean", "sd", "min", "max", "range", "p05", "p25", "median", "p75", "p95", "iqr")


def _moments(x: Column) -> list[Column]:
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max")]


def _measures(s: str, q: str) -> list[Column]:
    """MEASURES from a struct ``s`` of moments and an array ``q`` of quantiles."""
    at = {name: F.get(F.col(q), F.lit(k)) for k, name in enumerate(QUANTILES)}
    moments = [F.col(f"{s}.{m}").alias(m) for m in ("n", "mean", "sd", "min", "max")]
    span = (F.col(f"{s}.max") - F.col(f"{s}.min")).alias("range")
    return [*moments, span, *(v.alias(name) for name, v in at.items()), (at["p75"] - at["p25"]).alias("iqr")]


def describe_each(df: DataFrame, columns: list[str], by: list[str] | None = None, name: str = "measure") -> DataFrame:
    """A row for each column (and group): its ``name`` and MEASURES, all from one aggregate.

    The deviation is the population's; quantiles interpolate linearly. A column's distinct values are
    counted in one buffer for all of its quantiles: accuracies, of which ``n`` items allow some ``n`` squared.
    """
    quantiles = list(QUANTILES.values())
    parts = []
    for k, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [F.struct(*_moments(x)).alias(f"s{k}"), F.percentile(x, quantiles).alias(f"q{k}")]
    wide = (df.groupBy(*by) if by else df).agg(*parts)
    rows = F.array(*(F.struct(F.lit(c).alias(name), F.col(f"s{k}").alias("s"), F.col(f"q{k}").alias("q")) for k, c in enumerate(columns)))
    return wide.select(*(by or []), F.inline(rows)).select(*(by or []), name, *_measures("s", "q"))


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """One row (for each group): MEASURES of the column's non-null values."""
    return describe_each(df, [column], by, "__column").drop("__column")


def describe_continuous(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The same for a column of any number of distinct values: order statistics come from running counts over ranges, so no buffer holds a group."""
    x, g = F.col(column).cast("double"), ["__g"]
    keyed = df.withColumn("__g", F.struct(*by) if by else F.struct(F.lit(0).alias("one")))  # a struct: null keys are a group like any other
    moments = keyed.groupBy(*g).agg(F.struct(*_moments(x)).alias("s"))
    if not by:
        moments = df.agg(F.struct(*_moments(x)).alias("s")).withColumn("__g", F.struct(F.lit(0).alias("one")))
    counts = keyed.where(x.isNotNull()).groupBy(*g, x.alias("__x")).agg(F.count(F.lit(1)).alias("__times"))
    placed = running(counts, g, "__x", "__times", "__upto").join(moments.select("__g", F.col("s.n").alias("__size")), g)
    at = lambda index: F.min(F.when(F.col("__upto") > index, F.col("__x")))
    found = []
    for q in QUANTILES.values():
        exact = F.lit(q) * (F.col("__size") - 1)
        found.append(F.struct(at(F.floor(exact)).alias("a"), at(F.ceil(exact)).alias("b"), F.max(exact - F.floor(exact)).alias("f")))
    spots = placed.groupBy(*g).agg(F.array(*found).alias("__spots"))
    values = spots.select("__g", F.transform("__spots", lambda s: F.when(s["a"] == s["b"], s["a"]).otherwise((1 - s["f"]) * s["a"] + s["f"] * s["b"])).alias("q"))
    joined = moments.join(values, g, "left")  # groups without values keep their row of nulls
    return joined.select(*([F.col(f"__g.{c}") for c in by] if by else []), *_measures("s", "q"))


def histogram(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0, bins: int = 20) -> DataFrame:
    """A row a bin, empty ones included: bin, lower and upper edge, n. Values outside count in the end bins."""
    at = F.least(F.greatest(F.expr(f"cast((`{column}` - {low!r}D) / ({high!r}D - {low!r}D) * {bins} AS BIGINT)"), F.lit(0)), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.lit(low) + F.lit(high - low) * k / F.lit(bins)
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def score_histogram(df: DataFrame, column: str, n_items: int) -> DataFrame:
    """One bin for each score that ``n_items`` items allow."""
    return histogram(df, column, -0.5 / n_items, 1 + 0.5 / n_items, n_items + 1)
