"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About 600 kB of responses a file.
RECORDS_PER_FILE = 4000


def append_log(rows: DataFrame, directory: str, records: int = RECORDS_PER_FILE) -> None:
    """Appends responses, with columns task and model_slug, to a partitioned log, with ``at`` to tell appends apart. A task's rows appear together when it commits."""
    rows.withColumn("at", F.unix_micros(F.current_timestamp())).write.mode("append").option("maxRecordsPerFile", records).partitionBy("task", "model_slug").json(directory)


def read_appended(spark: SparkSession, directory: str, schema, partitions: tuple[str, ...] = ()) -> DataFrame:
    """An appended log; names of partitions are read as text."""
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType([*schema, *(T.StructField(c, T.StringType()) for c in partitions)])).json(directory)


def append_documents(rows: DataFrame, directory: str) -> None:
    """Appends a few records, one JSON line each."""
    rows.coalesce(1).write.mode("append").json(directory)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document, through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, indent=1, allow_nan=False), "utf-8"))
    out.close()
