"""Verdicts on whether wordings still ask the same question, and on whether answers repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def judgements(replies: DataFrame) -> DataFrame:
    """(id, text, reply) with verdict and reason; no reply is UNJUDGED."""
    said = F.coalesce(text.verdict(F.col("reply")), F.lit("UNJUDGED"))
    return replies.select("id", said.alias("verdict"), F.coalesce(text.verdict_reason(F.col("reply")), F.lit("")).alias("reason"), "text")


def tally(judged: DataFrame) -> DataFrame:
    """One row: n, equivalent, unjudged, and the rate, in which the unjudged count."""
    good = F.count_if(F.col("verdict").startswith("EQUIV"))
    n = F.count(F.lit(1))
    return judged.agg(n.alias("n"), good.alias("equivalent"), F.count_if(F.col("verdict") == "UNJUDGED").alias("unjudged"), F.try_divide(good.cast("double"), n.cast("double")).alias("rate"))


def round_trip_tally(trips: DataFrame) -> DataFrame:
    """One row over (verdict, slots_survived)."""
    return tally(trips).drop("unjudged").join(F.broadcast(trips.agg(F.count_if("slots_survived").alias("slots_survived"))))


def equivalent_ids(judged: DataFrame, canonical: int = 0) -> DataFrame:
    """Ids of wordings judged equivalent, and always the canonical one."""
    spark = judged.sparkSession
    return judged.where(F.col("verdict").startswith("EQUIV")).select(F.col("id").alias("p")).union(spark.range(canonical, canonical + 1).toDF("p")).distinct()


def only_equivalent(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of wordings in ``ids``; without a check, all of them."""
    return rows if ids is None else rows.join(ids, "p", "left_semi")


def repeat_agreement(pairs: DataFrame) -> DataFrame:
    """One row over (first, second, e): sample size, identical, failed, and the rate over the sample, with the failures reported beside it."""
    same = F.count_if(F.col("first") == F.col("second"))
    n = F.count(F.lit(1))
    return pairs.agg(n.alias("n"), same.alias("identical"), F.count_if(F.col("e").isNotNull()).alias("failed"), F.try_divide(same.cast("double"), n.cast("double")).alias("rate"))


def disagreements(pairs: DataFrame, limit: int = 12) -> DataFrame:
    """The first few answers that changed, cut for the record."""
    changed = pairs.where("e IS NULL AND first <> second").orderBy("p", "i").limit(limit)
    return changed.select("p", "i", F.substring("first", 1, 160).alias("first"), F.substring("second", 1, 160).alias("second"))
