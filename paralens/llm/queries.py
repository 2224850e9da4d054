"""The queries of this subpackage: thin digests over its operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_model, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts
from ..store import written


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all eight-word windows of the benchmark."""
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of all documents under the newest policy."""
    stored = written(quality_rules.ledger(quality_rules.measure(read(spark, sf_dir, "documents"))), "rule-ledger")
    policy = quality_rules.POLICIES[-1]
    base_failed = ~quality_rules.passes(quality_rules.BASE)
    return stored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & quality_rules.passes(policy)).alias("kept"), "fail_bits",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public 50k byte-level vocabulary."""
    import public_tokenizers

    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of six sevenths of them."""
    return language_model.score(read(spark, sf_dir, "documents"), held_out(2, 7))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say too of op4_lm_scoring: all columns but the network's score."""
    found = language_model.score(read(spark, sf_dir, "documents"), held_out(2, 7))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose four-word SimHash differs in at most 4 bits."""
    found = near_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the blocks of lines that stand earlier in the corpus."""
    return line_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that documents of smaller ids hold."""
    return suffix_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 0.98 of the entropy of equal sources, as many words as they have."""
    sized = written(read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("n_tokens")), "sized")
    plan = written(mixing.weights(sized), "mixture-weights")
    mixed = mixing.mix(sized, plan).withColumn("source", F.coalesce("source", F.lit("")))
    rated = plan.select("source", F.round("alpha", 6).alias("alpha"), F.round("weight", 6).alias("weight"))
    return mixed.join(F.broadcast(rated) if rated.limit(mixing.MAX_BROADCAST + 1).count() <= mixing.MAX_BROADCAST else rated, "source")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(third: int, of: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == third, F.lit(True))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels outside the held-out third."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(~held_out(1, 3)))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scoring": op4_lm_scoring,
    "lm_base_scores": lm_base_scores,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
}
