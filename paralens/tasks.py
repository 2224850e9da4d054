"""The tasks and their items: a registry that users can extend."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .functions import fixed


@dataclass(frozen=True)
class Item:
    key: str
    slots: dict[str, str]
    answer: str


@dataclass(frozen=True)
class Task:
    name: str
    canonical: str
    answer_kind: str
    slot_names: tuple[str, ...]
    items: tuple[Item, ...]
    labels: tuple[str, ...] = ()
    blurb: str = ""


def products(n: int = fixed.ITEMS_PER_TASK, seed: int = fixed.ITEM_SEED) -> tuple[Item, ...]:
    """Products of two different numbers, none of which ends in 0 or 1, no pair twice."""
    draw, found = random.Random(seed), {}
    hard = lambda x: x % 10 > 1
    while len(found) < n:
        pair = draw.randint(fixed.FACTOR_LOW, fixed.FACTOR_HIGH), draw.randint(fixed.FACTOR_LOW, fixed.FACTOR_HIGH)
        if hard(pair[0]) and hard(pair[1]) and pair[0] != pair[1]:
            found.setdefault(pair)
    return tuple(Item(f"mult-{a}x{b}", {"a": str(a), "b": str(b)}, str(a * b)) for a, b in found)


def entailments(n: int = fixed.ITEMS_PER_TASK) -> tuple[Item, ...]:
    """Four argument forms over each conditional: two valid ones and the two fallacies."""
    out: list[Item] = []
    first_upper = lambda s: s[:1].upper() + s[1:]
    for p, q in fixed.CONDITIONALS:
        forms = (
            ("mp", first_upper(p), q, "yes"), ("mt", f"It is not the case that {q}", p, "no"),
            ("ac", first_upper(q), p, "unknown"), ("da", f"It is not the case that {p}", q, "unknown"),
        )
        for form, fact, target, answer in forms:
            out.append(Item(f"{form}-{len(out)}", {"rule": f"If {p}, then {q}.", "fact": f"{fact}.", "target": first_upper(target)}, answer))
    return tuple(out[:n])


REGISTRY: dict[str, Task] = {}


def register(task: Task) -> Task:
    REGISTRY[task.name] = task
    return task


register(Task("mult", fixed.MULT_CANONICAL, "integer", ("a", "b"), products(), blurb="Products of two two-digit numbers."))
register(Task("entail", fixed.ENTAIL_CANONICAL, "label", ("rule", "fact", "target"), entailments(), fixed.LABEL_WORDS, "Conditional arguments, valid and fallacious."))


def get(name: str) -> Task:
    if name not in REGISTRY:
        raise KeyError(f"no task {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def items(spark: SparkSession, task: Task) -> DataFrame:
    """A row an item: task, ord, key, slots, answer."""
    return spark.createDataFrame([(task.name, k, x.key, x.slots, x.answer) for k, x in enumerate(task.items)], schemas.ITEM)
