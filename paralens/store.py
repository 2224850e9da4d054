"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: As many as Spark allows a table by default.
MAX_BUCKETS = 100_000
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or where that is unset one in the warehouse.

    Raises where both would be a machine-local path on a cluster: executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if not one_machine and (warehouse.startswith("file:") or warehouse.startswith("/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/.paralens"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # the session has ended; the folder may be removed by hand
        pass


def _scratch(spark: SparkSession, label: str) -> str:
    """A new path under this session's folder, which goes when the session ends."""
    root = f"{shared_dir(spark)}/paralens-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete_quietly, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, mb: int) -> Iterator[None]:
    """Meanwhile rows go to Python workers in Arrow batches of ``mb`` MB, or of one row if that is larger; 0 leaves them as they are.

    A task holds several copies of a batch outside the heap: Arrow's vectors, the buffer it is sent from and what a doubling leaves.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if mb:
        spark.conf.set(key, mb << 20)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Table:
    """A DataFrame written as Parquet; ``drop`` removes the files, and the catalog's entry if it has one, once nothing reads them.

    Readers hold the values of a row group of ``group_mb`` at once: tables of rows of some MB want small ones, and no
    ``dictionary``, in which a writer keeps copies of values that never come again. ``batch_mb``: see ``batches_of``.
    """

    def __init__(self, df: DataFrame, label: str, compression: str = "snappy", buckets: int = 0, key: str = "", group_mb: int = 128, batch_mb: int = 0, dictionary: bool = True):
        self.spark = df.sparkSession
        self.path = _scratch(self.spark, label)
        self.name = f"paralens_{label.replace('-', '_')}_{uuid.uuid4().hex}" if buckets else None
        writer = df.write.format("parquet").option("compression", compression).option("parquet.block.size", group_mb << 20).option("parquet.enable.dictionary", dictionary)
        if group_mb < 128:  # writers look at a page's or group's size after every so many rows only
            for kind in ("page", "block"):
                writer = writer.option(f"parquet.{kind}.size.row.check.min", 1).option(f"parquet.{kind}.size.row.check.max", 4)
        if self.name:
            with batches_of(self.spark, batch_mb):
                writer.bucketBy(buckets, key).option("path", self.path).saveAsTable(self.name)
            self.df = self.spark.table(self.name)
        else:
            with batches_of(self.spark, batch_mb):
                writer.save(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        _delete(self.spark, self.path)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read from a table in the shared folder."""
    return Table(df, label).df
