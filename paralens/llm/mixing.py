"""Mixtures of sources by temperature.

The weight of a source is its token share to the power alpha, normalised. Alpha is bisected in
[0, 1]: the largest that reaches a target entropy, raised where a source would otherwise be
repeated beyond a limit. A source's quota is its weight of the budget; it is filled with whole
passes over the source and one part of a pass, each pass a permutation of its own, and the
stream is cut into blocks that hold every source in proportion.

DataFrame and SQL expressions only. The position of a row in its pass comes from the permutation
key's leading digits, as many as leave BUCKET_ROWS rows of the largest source to one window: token sums of these buckets are added up first, so a source with a third of
all rows is still spread over thousands of windows. One row a source is all that is broadcast, and
only up to MAX_BROADCAST sources; beyond, alpha is bisected with an aggregate over the sources a step.

Null and empty sources are one source; null texts have no tokens; sources without tokens are taken
once; repeated rows are placed one by one; an empty table gives an empty mixture. Columns of the
input keep their names; ``epoch`` and ``block`` replace input columns so called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

SEED = 8001
MAX_BROADCAST = 100_000
BISECTIONS = 40
#: Leading digits of a row's place at least, and rows that share them at most.
BUCKET_DIGITS, BUCKET_ROWS = 3, 250_000
#: Of the entropy of equal weights.
TARGET_ENTROPY = 0.98
MAX_REPEATS = 4.0
BLOCK_TOKENS = 100_000
COVER = "cover"


def n_words(text: Column) -> Column:
    """Words that white space ends, as the tokens that weights are made of."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _alpha(shares: str, target: str | None, repeats: str) -> str:
    """SQL of alpha: ``target`` is SQL of the least entropy, if any, ``repeats`` of whether {a} keeps to the limit."""
    z = f"aggregate({shares}, 0D, (s, p) -> s + power(p, {{a}}))"
    mean = f"aggregate({shares}, 0D, (s, p) -> s + power(p, {{a}}) * ln(p))"
    entropy = f"(ln({z}) - {{a}} * {mean} / {z})"
    enough = f"({entropy} >= {target})"
    bisect = "aggregate(sequence(1, {n}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> if({left}, named_struct('lo', (b.lo + b.hi) / 2, 'hi', b.hi), named_struct('lo', b.lo, 'hi', (b.lo + b.hi) / 2)), b -> {end})"
    middle = {"a": "((b.lo + b.hi) / 2)"}
    by_entropy = f"if({enough.format(a='1D')}, 1D, {bisect.format(n=BISECTIONS, left=enough.format(**middle), end='b.lo')})"
    by_repeats = f"if({repeats.format(a='0D', z=z.format(a='0D'))}, 0D, {bisect.format(n=BISECTIONS, left='NOT ' + repeats.format(z=z.format(**middle), **middle), end='b.hi')})"
    return f"greatest({by_entropy}, {by_repeats})" if target else by_repeats


def weights(sized: DataFrame, tokens: str = "n_tokens", source: str = "source", budget: float | str = 1.0, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row a source: source, held (its tokens), rows, alpha, weight, quota, whole (passes) and rest (tokens of a part of a pass).

    ``budget`` is a multiple of all tokens, or COVER: as many as give every source at least one pass. ``target_entropy``
    is a share of the entropy of equal weights; None leaves alpha to the limit alone.
    """
    sums = sized.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.sum(tokens).cast("long").alias("held"), F.count(F.lit(1)).alias("rows"))
    sums = written(sums, "sources")
    if sums.limit(MAX_BROADCAST + 1).count() > MAX_BROADCAST:
        return _planned(sums, *_alpha_by_steps(sums, budget, target_entropy, max_repeats))
    one = sums.where("held > 0").agg(F.sort_array(F.collect_list("held")).alias("helds"), F.sum("held").cast("long").alias("total"))
    ratio = "array_max(helds) / array_min(helds)"
    if budget == COVER:
        limit = f"(power({ratio}, 1D - {{a}}) <= {float(max_repeats)}D)"
    else:
        limit = f"(power(array_min(shares), {{a}} - 1D) / {{z}} * {float(budget)}D <= {float(max_repeats)}D)"
    target = f"{float(target_entropy)}D * ln(cast(size(shares) AS DOUBLE))" if target_entropy is not None else None
    whole = "power(cast(array_max(helds) AS DOUBLE), 1D - alpha) * aggregate(helds, 0D, (s, h) -> s + power(cast(h AS DOUBLE), alpha))"
    chosen = (
        one.withColumn("shares", F.expr("transform(helds, h -> cast(h AS DOUBLE) / total)"))
        .withColumn("alpha", F.expr(_alpha("shares", target, limit)))
        .withColumn("z", F.expr("aggregate(shares, 0D, (s, p) -> s + power(p, alpha))"))
        .withColumn("budget", F.expr(whole if budget == COVER else f"total * {float(budget)}D"))
        .select("alpha", "z", "budget", "total")
    )
    alpha, z, tokens_, total = (chosen.first() or [None] * 4)
    if total is None:
        alpha, z, tokens_, total = 1.0, 1.0, 0.0, 1
    return _planned(sums, alpha, z, tokens_, total)


def _alpha_by_steps(sums: DataFrame, budget: float | str, target_entropy: float | None, max_repeats: float) -> tuple[float, float, float, int]:
    """alpha, z, tokens of the mixture and of the corpus, with an aggregate over the sources for every step of the bisections."""
    held = sums.where("held > 0")
    total, least, most, n = held.agg(F.sum("held"), F.min("held"), F.max("held"), F.count(F.lit(1))).first()

    def at(a: float) -> tuple[float, float]:
        p = F.col("held").cast("double") / F.lit(total)
        z, mean = held.agg(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))).first()
        return z, mean

    def enough(a: float) -> bool:
        z, mean = at(a)
        return math.log(z) - a * mean / z >= target_entropy * math.log(n)

    def within(a: float) -> bool:
        if budget == COVER:
            return (most / least) ** (1 - a) <= max_repeats
        return (least / total) ** (a - 1) / at(a)[0] * budget <= max_repeats

    def bisected(low_if, at_low: bool) -> float:
        low, high = 0.0, 1.0
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (middle, high) if low_if(middle) else (low, middle)
        return low if at_low else high

    by_repeats = 0.0 if within(0.0) else bisected(lambda a: not within(a), False)
    by_entropy = 0.0 if target_entropy is None else 1.0 if enough(1.0) else bisected(enough, True)
    alpha = max(by_entropy, by_repeats)
    z = at(alpha)[0]
    tokens = most ** (1 - alpha) * held.agg(F.sum(F.pow(F.col("held").cast("double"), F.lit(alpha)))).first()[0] if budget == COVER else total * float(budget)
    return alpha, z, tokens, total


def _planned(sums: DataFrame, alpha: float, z: float, tokens_: float, total: int) -> DataFrame:
    weight = F.when(F.col("held") > 0, F.pow(F.col("held").cast("double") / F.lit(total), F.lit(alpha)) / F.lit(z)).otherwise(F.lit(0.0))
    quota = F.floor(F.col("weight") * F.lit(tokens_) + 0.5).cast("long")
    return (
        sums.withColumn("alpha", F.lit(alpha))
        .withColumn("weight", weight)
        .withColumn("quota", quota)
        .withColumn("whole", F.when(F.col("held") > 0, F.expr("quota div held")).otherwise(F.lit(1)).cast("long"))
        .withColumn("rest", F.when(F.col("held") > 0, F.expr("quota % held")).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.lit(tokens_))
    )


def mix(docs: DataFrame, plan: DataFrame, tokens: str = "n_tokens", key: str = "doc_id", source: str = "source", block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mixture: a row for each time that a row is taken, with ``epoch`` (from 0) and ``block`` (from 0)."""
    mine = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("epoch", "block")]
    small = plan.select(F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in ("held", "quota", "whole", "rest")), F.greatest(F.lit(1), F.ceil(F.col("budget") / block_tokens)).cast("long").alias("__blocks"))
    if plan.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        small = F.broadcast(small)
    digits_, rows = BUCKET_DIGITS, plan.agg(F.max("rows")).first()[0] or 0
    while rows > BUCKET_ROWS * 16**digits_:
        digits_ += 1
    passes = F.col("__whole") + (F.col("__rest") > 0).cast("long")
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(f"`{key}`").cast("string")))
    taken = (
        docs.select(*mine, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"))
        .join(small, "__source")
        .where(passes > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
        .withColumn("__order", digits)
        .withColumn("__bucket", F.substring("__order", 1, digits_))
    )
    cell = ["__source", "epoch", "__bucket"]
    sums = taken.groupBy(*cell).agg(F.sum(tokens).alias("__sum"))
    along = Window.partitionBy("__source", "epoch").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.select(*cell, (F.sum("__sum").over(along) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy(*cell).orderBy("__order", F.col(f"`{key}`"), tokens).rowsBetween(Window.unboundedPreceding, 0)
    placed = taken.join(before, cell).withColumn("__at", F.col("__before") + F.sum(tokens).over(inside) - F.col(tokens))
    block = F.least(F.col("__blocks") - 1, F.expr("((epoch * __held + __at) * __blocks) div greatest(__quota, 1)"))
    return placed.where((F.col("epoch") < F.col("__whole")) | (F.col("__at") < F.col("__rest"))).select(*mine, F.col("epoch").cast("int").alias("epoch"), block.cast("long").alias("block"))
