"""Running accounts of a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from ..operators import accounting


def log_stream(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    """Responses as they are appended."""
    return spark.readStream.schema(schemas.RESPONSE).option("maxFilesPerTrigger", files_per_trigger).json(directory).where("p IS NOT NULL")


def running_accounts(log: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """Counts of outcomes by wording, each (wording, item) once; for output mode update or complete."""
    answers = items.select(F.col("key").alias("i"), "answer")
    rows = accounting.graded(log.dropDuplicates(["p", "i"]).join(F.broadcast(answers), "i"), kind)  # a few dozen items
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("attempts"), *(F.count_if(F.col("outcome") == o).alias(o) for o in fixed.OUTCOMES))
