"""A query for every operator, over general tables that stand in for the study's inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tasks
from .functions import features as feature_columns
from .functions import grading, text
from .operators import accounting, describe, equivalence, inference, pool
from .sources import responses as logs
from .sources.tables import dense_cells, responses, sparse_cells, table, templates

PERMUTATIONS, SPLITS, SHUFFLES = 1000, 200, 2000
HOURS = 24
#: Items that the stand-in log of work_list has answers to, one a wording.
DONE = tuple(x.key for x in tasks.get("mult").items[::5])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return accounting.graded(responses(spark, d), "integer")


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    return accounting.by_wording(_graded(spark, d))


def _accuracies(spark: SparkSession, d: str) -> DataFrame:
    """(p, acc) of the sparse matrix's complete wordings."""
    return inference.complete(sparse_cells(spark, d), HOURS).groupBy("p").agg(F.avg("c").alias("acc"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """(p, ord, name, x, y): features of templates, and as accuracies the share of items that labels and lengths make up."""
    rows = templates(spark, d, "n_chars % 25 / 24.0D AS y")
    return feature_columns.long_features(rows, "p", others=("y",))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Judge's replies: labelled quality decides the verdict, the rest has no reply."""
    labels = table(spark, d, "labels")
    said = F.expr("CASE quality WHEN 1 THEN concat(' equivalent ; same question, ', toxic) WHEN 0 THEN 'Different;drops the task' END")
    docs = table(spark, d, "documents")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), said.alias("reply"), "text")


@query
def grade_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("p", "i", "prediction", "outcome", "lenient")


@query
def grade_by_wording(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_accounts(spark, d))


@query
def label_extract(spark: SparkSession, d: str) -> DataFrame:
    found = grading.candidates(F.col("text"), "label")
    answer = F.expr("CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END")
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("labels"), grading.outcome(F.col("text"), answer, "label").alias("outcome"), grading.lenient(F.col("text"), answer, "label").alias("lenient"))


@query
def accounting_totals(spark: SparkSession, d: str) -> DataFrame:
    return accounting.totals(_accounts(spark, d))


@query
def usable_wordings(spark: SparkSession, d: str) -> DataFrame:
    return accounting.usable(_graded(spark, d), 20)


@query
def complete_wordings(spark: SparkSession, d: str) -> DataFrame:
    return inference.complete(sparse_cells(spark, d), HOURS)


@query
def duplicates_check(spark: SparkSession, d: str) -> DataFrame:
    return accounting.duplicates(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("i")))


@query
def describe_strict(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(describe.describe(_accounts(spark, d), "strict_accuracy"))


@query
def describe_parsed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(describe.describe(_accounts(spark, d), "parsed_accuracy"))


@query
def describe_groups(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(describe.describe_continuous(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), 4)


@query
def histogram_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(describe.score_histogram(_accuracies(spark, d), "acc", HOURS))


@query
def histogram_clamped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(describe.histogram(table(spark, d, "events"), "value", 1.0, 90.0, 20))


@query
def best_worst(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(accounting.best_and_worst(_accounts(spark, d)))


@query
def canonical_rank(spark: SparkSession, d: str) -> DataFrame:
    every = _accuracies(spark, d)
    return _rounded(accounting.canonical_rank(every, _dense_accuracies(spark, d), canonical=1, value="acc"))


def _dense_accuracies(spark: SparkSession, d: str) -> DataFrame:
    return dense_cells(spark, d).groupBy("p").agg(F.avg("c").alias("acc"))


@query
def cochran_q(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.cochran_q(dense_cells(spark, d)))


@query
def cochran_q_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.cochran_q(inference.complete(sparse_cells(spark, d), HOURS)))


@query
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.permutation_null(dense_cells(spark, d), PERMUTATIONS))


@query
def spread_test(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.spread_test(inference.complete(sparse_cells(spark, d), HOURS), PERMUTATIONS))


@query
def split_half(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.split_halves(dense_cells(spark, d), SPLITS))


@query
def split_half_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.split_half_reliability(inference.complete(sparse_cells(spark, d), HOURS), SPLITS))


@query
def feature_values(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feature_columns.with_features(templates(spark, d)).drop("text"))


@query
def feature_spearman(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.spearman(inference.rank_pairs(_features(spark, d))).select("name", "n", "rho"))


@query
def spearman_perm_p(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.spearman_permutation_p(inference.rank_pairs(_features(spark, d)), SHUFFLES).select("name", "rho", "p"))


@query
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.feature_table(_features(spark, d), SHUFFLES))


@query
def holm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey AS ord", "p_name AS name", "p_size / 2000.0D AS p", "p_brand")
    return _rounded(inference.holm(p, ["p_brand"]))


@query
def normalise_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), "text")
    return pool.first_of_each(rows).select("id", "norm", "copies")


@query
def candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("- 1) "), "text").alias("reply"), F.col("doc_id").alias("ord"))
    rows = pool.candidate_rows(docs)
    return rows.select("doc_id", F.col("ord.line").alias("line"), "text")


@query
def validate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pool.validated(templates(spark, d), tasks.get("mult")).select("p", "reason")


@query
def validate_label_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("p"), F.expr("concat('{rule} {fact} {target} YES no ', text, CASE WHEN doc_id % 2 = 0 THEN ' Unknown?' ELSE '{x}' END)").alias("text"))
    one_line = rows.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return pool.validated(one_line, tasks.get("entail")).select("p", "reason")


@query
def rejected_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pool.rejected(pool.validated(templates(spark, d), tasks.get("mult")))


@query
def pool_extend(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("style"), "text", F.lit("author").alias("source"))
    new = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("ord"), F.col("lang").alias("style"), "text")
    return pool.extended(old, new).select("id", "style", "source", F.md5("text").alias("text_md5"))


@query
def sample_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    return pool.sampled(table(spark, d, "documents").select("doc_id"), 40, 17, "doc_id")


@query
def style_combinations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pool.shuffled_combinations(docs.select(F.col("lang").alias("style")).distinct(), docs.select(F.col("source").alias("axis")).distinct(), 200)


@query
def equivalence_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(equivalence.tally(equivalence.judgements(_replies(spark, d))))


@query
def round_trip_rate(spark: SparkSession, d: str) -> DataFrame:
    trips = equivalence.judgements(_replies(spark, d)).withColumn("slots_survived", F.col("id") % 5 == 0)
    return _rounded(equivalence.round_trip_tally(trips))


@query
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return equivalence.judgements(_replies(spark, d)).select("id", "verdict", "reason")


@query
def equivalence_filter(spark: SparkSession, d: str) -> DataFrame:
    ids = equivalence.equivalent_ids(equivalence.judgements(_replies(spark, d)))
    return _rounded(equivalence.only_equivalent(_accounts(spark, d), ids).select("p", "attempts", "strict_accuracy"))


@query
def work_list(spark: SparkSession, d: str) -> DataFrame:
    wordings = templates(spark, d).select(F.col("p").alias("id"), F.concat(F.lit("What is {a} times {b}? "), "text").alias("text"))
    items = tasks.items(spark, tasks.get("mult"))
    done = table(spark, d, "labels").select(F.col("doc_id").alias("p"), F.element_at(F.array(*map(F.lit, DONE)), (F.col("doc_id") % len(DONE) + 1).cast("int")).alias("i"), F.lit("x").alias("r"), F.lit(None).cast("string").alias("e"))
    return pool.work_list(wordings, items, done).select("p", "i", "prompt", "turn", "ord")


@query
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    slots = F.create_map(F.lit("a"), F.col("p").cast("string"), F.lit("b"), F.lit("{a}"))
    return templates(spark, d).select("p", text.rendered(F.col("text"), slots).alias("prompt"))


@query
def repeat_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(equivalence.repeat_agreement(_pairs(spark, d)))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("p"), F.col("turn").cast("string").alias("i"), F.col("text").alias("first"))
    again = F.expr("CASE WHEN p % 7 = 0 THEN NULL WHEN p % 5 = 0 THEN concat(first, '!') ELSE first END")
    return asked.select("p", "i", "first", again.alias("second"), F.expr("CASE WHEN p % 7 = 0 THEN 'timeout' END").alias("e"))


@query
def repeat_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return equivalence.disagreements(_pairs(spark, d))


@query
def discover_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = docs.select(F.concat(F.col("lang"), F.lit("__"), F.translate("source", "1", "-"), F.lit("__"), F.lpad(F.col("doc_id").cast("string"), 3, "0"), F.lit(".jsonl")).alias("name"))
    metas = docs.select(F.col("lang").alias("task"), F.translate("source", "1", ":").alias("model"))
    return logs.runs(names, metas.distinct())


@query
def mult_items(spark: SparkSession, d: str) -> DataFrame:
    return tasks.items(spark, tasks.get("mult")).select("ord", "key", "answer", F.col("slots")["a"].alias("a"), F.col("slots")["b"].alias("b"))


@query
def entail_items(spark: SparkSession, d: str) -> DataFrame:
    return tasks.items(spark, tasks.get("entail")).select("ord", "key", "answer", *(F.col("slots")[s].alias(s) for s in ("rule", "fact", "target")))


@query
def analysis_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: grade, account, keep usable wordings, describe."""
    accounts = _accounts(spark, d).where("attempts >= 20 AND error * 3 < attempts")
    measured = describe.describe_each(accounts, ["strict_accuracy", "parsed_accuracy", "lenient_accuracy"])
    return _rounded(measured.withColumn("measure", F.replace("measure", F.lit("_accuracy"), F.lit(""))))
