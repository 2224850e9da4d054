"""The study's own files: response logs, pools, judgements and run descriptions.

A log is a set of JSON-lines files named ``{task}__{model}__{number}.jsonl``; lines that are blank
are skipped. Tables written by ``sinks`` are partitioned by task and model instead.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def model_slug(model: str) -> str:
    """The model's name as file names have it; different names can share one."""
    return model.translate(str.maketrans(":/", "--"))


def _escaped(name: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def log_glob(directory: str, task: str, model: str) -> str:
    return f"{directory}/{_escaped(task)}__{_escaped(model_slug(model))}__*.jsonl"


def read_log(spark: SparkSession, directory: str, task: str, model: str) -> DataFrame:
    """All responses of a run with their ``file`` and ``at``, their place in the log: by file name, then line; none if there is no log yet."""
    place = F.struct(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    try:
        rows = spark.read.schema(schemas.RESPONSE).json(log_glob(directory, task, model)).select("*", place.alias("at"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        rows = spark.createDataFrame([], schemas.RESPONSE).select("*", F.expr("named_struct('file', '', 'start', 0L, 'line', 0L)").alias("at"))
    return rows.where("p IS NOT NULL").withColumn("file", F.col("at.file"))


def done_keys(log: DataFrame) -> DataFrame:
    """Calls that have been made, failed ones included."""
    return log.select("p", "i").distinct()


def file_names(spark: SparkSession, directory: str, pattern: str = "*__*.jsonl") -> DataFrame:
    """Names of log files; their contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    return files.select(F.regexp_extract("path", r"[^/]+\z", 0).alias("name"))


def runs(names: DataFrame, metas: DataFrame) -> DataFrame:
    """(task, model) of every run that has a log, by task and model; the slug stands for a model without a description."""
    stem = F.regexp_extract("name", r"^(.+)__[^_]*\.jsonl\z", 1)
    found = names.select(F.split(stem, "__", 2)[0].alias("task"), F.expr(r"regexp_extract(name, '^.+?__(.+)__[^_]*[.]jsonl$', 1)").alias("slug")).where("slug <> ''").distinct()
    return named(found, metas)


def named(found: DataFrame, metas: DataFrame) -> DataFrame:
    """(task, model, slug) of runs (task, slug), the model's name taken from run descriptions where there are any."""
    known = metas.select("task", "model", F.translate("model", ":/", "--").alias("slug")).groupBy("task", "slug").agg(F.min("model").alias("model"))
    return found.join(known, ["task", "slug"], "left").select("task", F.coalesce("model", "slug").alias("model"), "slug").orderBy("task", "model")


def read_json_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """The wordings of a pool file: task, ord, id, style, text, source."""
    return read_json_documents(spark, path, schemas.POOL).select("task", F.posexplode("paraphrases").alias("ord", "w")).select("task", "ord", "w.*")


def read_equivalent_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """Ids of a judgement file, or None where no check has been made: then nothing is filtered."""
    try:
        return read_json_documents(spark, path, schemas.EQUIVALENCE).select(F.explode("equivalent_ids").alias("p")).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise
