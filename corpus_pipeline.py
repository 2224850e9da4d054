"""The corpus pipeline: five stages from all documents to balanced shards.

``run`` writes every stage's result as Parquet in the folder that the cluster shares and reads it
as the next one's documents, so a lost executor never repeats more than one stage.

Columns of the documents come back from every stage as they are, extra ones of any name among them; ``doc_id``,
``text`` and ``source`` must be there (the last stage adds its own columns, which replace input columns so
called). Null texts are empty: the classifier scores them like any other, they are one group of near-duplicates, hold no
window and no tokens, and have size 1. Rows without an id take part in everything but the labels: different texts
without an id, or of one id, all stay, and of equal rows one. Null sources are one source. Of ties the smallest id stays.
Texts are taken whole, however long. No documents give no shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralens.llm import decontamination, mixing, quality_classifier, sharding, similar_texts
from paralens.llm.queries import held_out, read
from paralens.store import Table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Followed by its place, the name of a column that an operator would take for its own or can't name.
KEPT = "__kept_"


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns of these names, or of names with a dot, called otherwise."""
    return docs.select(*(F.col(f"`{c}`").alias(f"{KEPT}{k}" if c.lower() in names or "." in c else c) for k, c in enumerate(docs.columns)))


def as_in(docs: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``docs``, from those of ``df``, where some may be called otherwise."""
    return df.select(*(F.col(f"{KEPT}{k}").alias(c) if f"{KEPT}{k}" in df.columns else F.col(f"`{c}`") for k, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of these documents outside the held-out third."""
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels").where(~held_out(1, 3)))
    named = aside(docs, "score", "__text")
    others = tuple(c for c in named.columns if c not in ("doc_id", "text"))
    return as_in(docs, quality_classifier.score(named, model, carry=others, keep_text=True).where("score >= 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group that five-word shingles of a similarity of 0.8 or SimHash links join."""
    return similar_texts.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item: one leaked passage is enough to go. Rows without an id count as one document."""
    found = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    dirty = found.where(F.size("items") >= 1).select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col("__dirty")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; sources with few words again, up to two passes, as the temperature says."""
    sized = aside(docs, "n_tokens", "epoch", "block").withColumn("n_tokens", mixing.n_words(F.col("text")))
    plan = written(mixing.weights(sized, budget=mixing.COVER, target_entropy=None, max_repeats=2.0), "mixture-weights")
    return as_in(docs, mixing.mix(sized, plan))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 16 and place in it."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("source_mixing", mixture),
    ("sharding", shards),
]

#: The classifier and fingerprints are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
