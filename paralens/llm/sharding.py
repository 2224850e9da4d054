"""Shards of near-equal bytes from sampled splitters.

1. A size-weighted sample of the keys (a row is drawn if a hash of it falls below its share) gives
   quantile boundaries, so ranges of the key hold about equal bytes wherever the keys lie.
2. Exact bytes of the ranges show the overfull ones, as of one key with very many rows or of a table too
   large for its boundaries; they are subdivided by a hash of the row into cells of CELL_BYTES.
3. Rows that alone exceed a hundredth of a shard, at most ``100 * shards`` of them, are dealt in
   snake order; the cells, in order, then fill every shard up to one common level.

All of it is DataFrame expressions. Keys, sizes and hashes are stored once, and boundaries, cells and levels come
from these; the rows themselves are read once more and move once, dealt by cell, and no window spans more than one cell. What reaches the driver is
a row of totals, the boundaries and a row a shard. Cells are looked up in a broadcast table of at most
``2 * ranges`` rows and one for each CELL_BYTES of input.

Null texts have size 1, null keys come first as one key, an empty table gives an empty result. Equal rows are placed one by one;
should more than MANY_EQUAL rows share id and text, all rows are stored and numbered, so that these too are subdivided. Columns of the
input come back as they are; those that the operator adds replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

HEAVY = 100
SAMPLE_PER_RANGE = 100
#: Ranges are of 256 MB, and at least and at most so many; what is larger is subdivided.
LEAST_RANGES, MOST_RANGES = 256, 4096
CELL_BYTES = 1 << 28
#: Equal rows that one window sorts.
MANY_EQUAL = 1_000_000
SEED = 7001
SMALLEST = -(1 << 63)


def _with_range(df: DataFrame, bounds: list[int]) -> DataFrame:
    """The rows with ``__range``: how many of the sorted boundaries lie below the key, by binary search, a column a step."""
    out = df.withColumn("__range", F.lit(0))
    if not bounds:
        return out
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # folded into one literal
    for step in (1 << k for k in reversed(range(len(bounds).bit_length()))):
        below = F.coalesce(F.get(table, F.col("__range") + (step - 1)) < F.col("__key"), F.lit(False))  # beyond the last there is none
        out = out.withColumn("__range", F.col("__range") + F.when(below, step).otherwise(0))
    return out


def water_level(loads: list[int], total: int) -> list[int]:
    """What each shard still takes of ``total`` so that all end at one level; none gives up its load."""
    order, level = sorted(loads), 0.0
    for k in range(1, len(order) + 1):
        level = (total + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0, round(level - x)) for x in loads]


def shard(docs: DataFrame, shards: int = 16, key_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot`` (0, 1, ... in each shard).

    ``key_col`` is an integer. Shards differ by about a hundredth, or by what one larger row brings.
    """
    taken = {"size", "shard", "slot"}
    names = [c for c in docs.columns if c.lower() not in taken]

    def sized(df: DataFrame, *salt: str) -> DataFrame:
        text = F.col(text_col).cast("string")
        return df.select(
            *(F.col(f"`{c}`") for c in names), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.col(key_col).cast("long"), F.lit(SMALLEST)).alias("__key"), F.xxhash64(F.lit(seed), F.col(key_col).cast("long"), text, *salt).alias("__tie"),
        )

    rows = sized(docs)
    keys = written(rows.select("__key", "size", "__tie"), "shard-keys")
    total, n = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return rows.select(*rows.columns[:-2], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if keys.groupBy("__key", "__tie").count().where(F.col("count") > MANY_EQUAL).limit(1).count():
        numbered = written(docs.withColumn("__nth", F.monotonically_increasing_id()), "numbered")
        rows = sized(numbered, "__nth")
        keys = written(rows.select("__key", "size", "__tie"), "shard-keys")
    ranges = ranges or max(LEAST_RANGES, min(MOST_RANGES, total >> 28))
    heavy = F.col("size") * (HEAVY * shards) > F.lit(total)

    unit = F.pmod(F.col("__tie"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sampled = keys.where(~heavy & (unit < F.col("size") * (ranges * SAMPLE_PER_RANGE / total)))
    bounds = sorted(set(sampled.agg(F.percentile_approx("__key", [k / ranges for k in range(1, ranges)], 20000)).first()[0] or []))

    target = min(-(-total // ranges), CELL_BYTES)
    in_range = _with_range(keys.where(~heavy), bounds).groupBy("__range").agg(F.sum("size").alias("b"))
    overfull = in_range.where(F.col("b") > 2 * target).select("__range", F.ceil(F.col("b") / target).cast("int").alias("__ways"))
    overfull = F.broadcast(written(overfull, "overfull"))  # at most a row a range

    def celled(df: DataFrame) -> DataFrame:
        """The light rows with their cell."""
        placed = _with_range(df.where(~heavy), bounds).join(overfull, "__range", "left")
        return placed.withColumn("__part", F.pmod(F.col("__tie"), F.coalesce("__ways", F.lit(1))).cast("int")).drop("__ways")

    cell = ["__range", "__part"]
    sums = celled(keys).groupBy(*cell).agg(F.sum("size").alias("b"))
    along = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, 0)  # a row a cell, as few as the docstring says
    before = written(sums.select(*cell, (F.sum("b").over(along) - F.col("b")).alias("__before")), "cells")

    snake = Window.orderBy(F.col("size").desc(), "__key", "__tie")
    turn = F.col("__rank") % shards

    def dealt(df: DataFrame) -> DataFrame:
        ranked = df.where(heavy).withColumn("__rank", F.row_number().over(snake) - 1)  # at most 100 * shards rows
        return ranked.withColumn("shard", F.when(F.floor(F.col("__rank") / shards) % 2 == 0, turn).otherwise(shards - 1 - turn).cast("int"))

    loads = {r[0]: (r[1], r[2]) for r in dealt(keys).groupBy("shard").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    room = water_level([loads.get(s, (0, 0))[0] for s in range(shards)], total - sum(load for load, _ in loads.values()))
    ends = [sum(room[: s + 1]) for s in range(shards - 1)]

    inside = Window.partitionBy(*cell).orderBy("__key", "__tie", "size")

    def filled(df: DataFrame) -> DataFrame:
        """The light rows with their shard: where their middle lies in the line of all cells."""
        middle = F.col("__before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
        place = sum(((F.col("__middle") >= F.lit(float(e))).cast("int") for e in ends), F.lit(0))
        return celled(df).join(F.broadcast(before), cell).withColumn("__middle", middle).withColumn("shard", place.cast("int"))

    counts = filled(keys).groupBy(*cell, "shard").agg(F.count(F.lit(1)).alias("n"))
    heavies = F.array(*(F.lit(loads.get(s, (0, 0))[1]).cast("long") for s in range(shards)))
    so_far = F.sum("n").over(Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = written(counts.select(*cell, "shard", (so_far + F.element_at(heavies, F.col("shard") + 1)).alias("__start")), "slots")  # a row a cell and shard

    nth = Window.partitionBy(*cell, "shard").orderBy("__key", "__tie", "size")
    keep = [F.col(f"`{c}`") for c in names] + [F.col("size")]
    light = filled(rows).withColumn("__nth_here", F.row_number().over(nth) - 1).join(F.broadcast(starts), [*cell, "shard"])
    heavy_slot = (F.row_number().over(Window.partitionBy("shard").orderBy("__rank")) - 1).cast("long")
    return light.select(*keep, "shard", (F.col("__start") + F.col("__nth_here")).cast("long").alias("slot")).unionByName(dealt(rows).select(*keep, "shard", heavy_slot.alias("slot")))
