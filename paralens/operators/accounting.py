"""Grading responses and accounting for them by wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, grading

ACCURACIES = ("strict_accuracy", "parsed_accuracy", "lenient_accuracy")


def graded(responses: DataFrame, kind: str, text: str = "r", answer: str = "answer") -> DataFrame:
    """The responses with their prediction, outcome and lenient verdict."""
    t, a = F.col(text), F.col(answer)
    return responses.select(
        "*", grading.prediction(grading.candidates(t, kind)).alias("prediction"), grading.outcome(t, a, kind).alias("outcome"), grading.lenient(t, a, kind).alias("lenient")
    )


def with_answers(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Responses with their item's answer; a response to an item that doesn't exist is an error."""
    answers = items.select(F.col("key").alias("i"), "answer")  # one row an item: a task has a few dozen
    joined = responses.join(F.broadcast(answers) if answers.limit(10_001).count() <= 10_000 else answers, "i", "left")
    checked = F.when(F.col("answer").isNull(), F.raise_error(F.concat(F.lit("response to an unknown item: "), F.col("i")))).otherwise(F.col("answer"))
    return joined.withColumn("answer", checked)


def latest(responses: DataFrame, order: str = "at") -> DataFrame:
    """The last record by ``order`` of each call (p, i): a retry replaces what failed before it."""
    rest = [F.col(c) for c in responses.columns if c not in ("p", "i")]
    return responses.groupBy("p", "i").agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select("p", "i", "__last.*")


def _share(part: Column, whole: Column) -> Column:
    """Null, which is not zero, where nothing could be measured."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def by_wording(rows: DataFrame, key: str = "p") -> DataFrame:
    """Counts and accuracies of each wording's graded responses.

    Strict counts what can't be parsed against a wording, parsed leaves it out, lenient takes any right candidate; failed calls count in none.
    """
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in fixed.OUTCOMES]
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), *counts, F.count_if(F.col("lenient")).alias("lenient_correct"))
    scored = F.col("attempts") - F.col("error")
    return out.select(
        "*", _share(F.col("correct"), scored).alias("strict_accuracy"), _share(F.col("correct"), F.col("correct") + F.col("wrong")).alias("parsed_accuracy"),
        _share(F.col("lenient_correct"), scored).alias("lenient_accuracy"),
    )


def cells(rows: DataFrame, key: str = "p", item: str = "i", latest: str | None = None) -> DataFrame:
    """The matrix in long form: a row for each wording and item with c = 1 if correct. Of several responses the last by ``latest`` counts."""
    c = (F.col("outcome") == "correct").cast("int")
    value = F.max_by(c, F.col(latest)) if latest else F.max(c)
    return rows.groupBy(F.col(key).alias("p"), F.col(item).alias("i")).agg(value.alias("c"))


def totals(accounted: DataFrame) -> DataFrame:
    """One row: sums over wordings."""
    return accounted.agg(F.count(F.lit(1)).alias("wordings"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attempts", *fixed.OUTCOMES, "lenient_correct")))


def usable(rows: DataFrame, n_items: int, key: str = "p") -> DataFrame:
    """Wordings with a response for every item: key, attempts, failed calls, and ``kept`` where none failed."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") == "error").alias("failed"))
    return out.where(F.col("attempts") >= n_items).withColumn("kept", F.col("failed") == 0)


def duplicates(rows: DataFrame, key: str = "p", item: str = "i") -> DataFrame:
    """One row: responses, distinct (wording, item) pairs, and how many are too many."""
    pairs = rows.groupBy(key, item).agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.sum("n").cast("long").alias("responses"), F.count(F.lit(1)).alias("pairs"), (F.sum("n") - F.count(F.lit(1))).cast("long").alias("duplicates"))


def best_and_worst(accounted: DataFrame, key: str = "p", value: str = "strict_accuracy") -> DataFrame:
    """One row: the best and worst wording; of equals the smallest id."""
    id_, v = F.col(key), F.col(value)
    return accounted.where(v.isNotNull()).agg(
        F.max_by(id_, F.struct(v, -id_)).alias("best"), F.max(v).alias("best_value"), F.min_by(id_, F.struct(v, id_)).alias("worst"), F.min(v).alias("worst_value")
    )


def canonical_rank(kept: DataFrame, everyone: DataFrame, canonical: int = 0, key: str = "p", value: str = "strict_accuracy") -> DataFrame:
    """One row: the canonical wording's accuracy, looked up before any filter, and the share of the kept wordings that don't exceed it; nulls if it has none."""
    own = everyone.where(F.col(key) == canonical).agg(F.max(value).alias("canonical_accuracy"))
    return kept.join(F.broadcast(own)).agg(
        F.max("canonical_accuracy").alias("canonical_accuracy"), F.avg((F.col(value) <= F.col("canonical_accuracy")).cast("int")).alias("canonical_percentile")
    )
