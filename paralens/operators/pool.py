"""Pools of wordings: cleaning, validating, exact dedup, and what has to be asked next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..tasks import Task
from .inference import order_key
from .ordered import numbered

#: Items of a task, which are written out in the plan of its work list.
MOST_ITEMS = 1000


def candidate_rows(replies: DataFrame, reply: str = "reply", order: str = "ord") -> DataFrame:
    """A row a candidate line of every reply, with ``ord`` (reply, line) to tell which came first."""
    others = [c for c in replies.columns if c not in (reply, order)]
    lines = F.posexplode(text.candidate_lines(F.col(reply))).alias("line", "text")
    return replies.select(*others, F.col(order).alias("call"), lines).select(*others, F.struct("call", "line").alias("ord"), "text")


def validated(candidates: DataFrame, task: Task, column: str = "text", balanced: bool = False) -> DataFrame:
    """The candidates with ``reason``, null where they can be used."""
    return candidates.withColumn("reason", text.rejection(F.col(column), task.slot_names, task.name, balanced))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL").drop("reason")


def rejected(rows: DataFrame, column: str = "text") -> DataFrame:
    """What was rejected and why, the text cut for the record."""
    return rows.where("reason IS NOT NULL").select(F.substring(column, 1, 300).alias("text"), "reason")


def first_of_each(candidates: DataFrame, column: str = "text", order: str = "ord") -> DataFrame:
    """The first row of every normalised text with the number of rows that it stands for. An aggregate, so a text that everyone wrote makes no hot window."""
    rest = [c for c in candidates.columns if c != order]
    row = F.struct(F.col(order), *(F.col(c) for c in rest))
    grouped = candidates.groupBy(text.normalised(F.col(column)).alias("norm")).agg(F.min_by(row, F.col(order)).alias("first"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("norm", "first.*", "copies")


def extended(pool: DataFrame, candidates: DataFrame, source: str = "generated") -> DataFrame:
    """The pool (id, style, text, source) and behind it the valid candidates (ord, style, text) that are new to it, numbered on in order."""
    known = pool.select(text.normalised(F.col("text")).alias("norm"))
    fresh = first_of_each(candidates).join(known, "norm", "left_anti")
    last = pool.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last")).first()[0]
    nth = F.col("__nth") + F.lit(last)
    added = numbered(fresh, ["ord"], "__nth").select(nth.cast("long").alias("id"), "style", "text", F.lit(source).alias("source"))
    return pool.select("id", "style", "text", "source").unionByName(added)


def sampled(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer; the same ones every time."""
    return df.orderBy(order_key(seed, *map(F.col, keys)), *keys).limit(n)


def shuffled_combinations(first: DataFrame, second: DataFrame, calls: int, seed: int = fixed.SEED_GENERATE) -> DataFrame:
    """A style and an axis for each of ``calls`` calls: all combinations in a fixed random order, over and over. Both tables are short lists."""
    combos = first.join(F.broadcast(second))
    nth = combos.withColumn("nth", F.row_number().over(Window.orderBy(order_key(seed, F.col("style"), F.col("axis")), "style", "axis")) - 1)
    n = nth.agg(F.count(F.lit(1)).alias("of"))
    numbers = first.sparkSession.range(calls).select(F.col("id").alias("call")).join(F.broadcast(n)).where("of > 0")
    return numbers.join(F.broadcast(nth), F.col("nth") == F.col("call") % F.col("of")).select("call", "style", "axis")


def generation_prompt(task: Task, style: Column, axis: Column, n: int, avoid: Column | None = None) -> Column:
    """The text that asks a generator for ``n`` wordings; ``avoid``, an array, adds those that exist."""
    slots = ", ".join("{" + s + "}" for s in task.slot_names)
    extra = {"mult": "The answer must still be one number standing alone.", "entail": "The three options must be called YES, NO and UNKNOWN."}.get(task.name, "")
    head = f"Rewrite this instruction in {n} different ways.\n\n{' '.join(task.canonical.split())}\n\nStyle: "
    rules = f"\nKeep each of these placeholders exactly once: {slots}. Ask for the same thing, no more and no less. {extra} Give no answers or examples.\n"
    block = F.lit("")
    if avoid is not None:
        block = F.when(F.size(avoid) > 0, F.concat(F.lit("Differ from these:\n"), F.array_join(avoid, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(head), style, F.lit("\nAlso: "), axis, F.lit(rules), block, F.lit(f"Write {n} lines, one wording a line, and nothing else.\n"))


def work_list(pool: DataFrame, items: DataFrame, done: DataFrame, limit: int | None = None, first: int | None = None, seed: int = fixed.SEED_ORDER, retry_failed: bool = False) -> DataFrame:
    """The calls still to make: p, i, prompt, in visiting order (``turn``, ``ord``).

    Wordings come in a fixed random order with all their items side by side, so a run that is cut
    short leaves complete rows of a random part of the pool. ``first`` takes wordings in pool order
    before that, ``limit`` calls after it. Failed calls count as done unless ``retry_failed``.
    """
    wordings = pool.orderBy("id").limit(first) if first is not None else pool
    asked = done.where("e IS NULL OR r IS NOT NULL") if retry_failed else done
    listed = items.select("key", "slots", "ord").limit(MOST_ITEMS + 1).collect()
    if len(listed) > MOST_ITEMS:
        raise ValueError(f"a task has at most {MOST_ITEMS} items")
    every = F.array(*(
        F.struct(F.lit(x["key"]).alias("i"), F.lit(x["ord"]).alias("ord"), F.create_map(*(F.lit(v) for pair in sorted(x["slots"].items()) for v in pair)).alias("slots")) for x in listed
    ))
    # Keys before texts: a wording meets the set of its own answered items, at most one entry an item, and is copied only for what is left.
    answered = asked.where(F.col("i").isin([x["key"] for x in listed])).groupBy("p").agg(F.collect_set("i").alias("__had"))
    open_ = wordings.select(F.col("id").alias("p"), text.cut(F.col("text"), strict=True).alias("parts"), order_key(seed, F.col("id")).alias("turn")).join(answered, "p", "left")
    missing = F.filter(every, lambda x: ~F.coalesce(F.array_contains("__had", x["i"]), F.lit(False)))
    left = open_.select("p", "parts", "turn", F.explode(missing).alias("x"))
    out = left.select("p", F.col("x.i").alias("i"), text.filled(F.col("parts"), F.col("x.slots"), strict=True).alias("prompt"), "turn", F.col("x.ord").alias("ord"))
    return out.orderBy("turn", "p", "ord").limit(limit) if limit is not None else out
