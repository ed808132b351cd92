"""Tables written to, and read back from, the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lets shuffle files go once the job that made them has ended; a lost one is made again from its lineage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows differ in length by orders of magnitude, so a batch is bounded by bytes, not by rows alone.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="evigraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def hashed_sample(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """All rows if there are no more than ``size``, else about nine tenths of that many with small hashes of the columns, never more than ``size``.

    The same rows give the same sample: what the filter on hashes leaves, about
    as many rows, is cut by hash, then by the columns. No other text moves.
    """
    n = rows.count()
    if n <= size:
        return rows
    some = rows.withColumn("_hash", F.expr(f"pmod(xxhash64({', '.join(columns)}), 1000000000)")).filter(F.col("_hash") < int(0.9e9 * size / n))
    return some.orderBy("_hash", *columns).limit(size).drop("_hash")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that Python workers get, unless the session bounds them lower."""
    now = spark.conf.get(BATCH_BYTES, None)
    if now is None or not now.isdigit() or int(now) > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))


@contextlib.contextmanager
def _freeing_shuffles(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


_made: list[Workspace] = []


@contextlib.contextmanager
def dropped_after():
    """Frees, at its end, the folders of all operators called inside: their results must have been written by then.

    An operator's result reads its tables for as long as it is used, so only its
    caller knows when they may go.
    """
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _made.pop().close()


class Workspace:
    """A folder of one operator call under the shared folder."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/evigraph-{uuid.uuid4().hex}"
        _made.append(self)

    def written(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Cuts lineage and fixes sizes: writes df as Parquet and reads it back."""
        schema = df.schema
        writer = df.write.mode("overwrite")
        with _freeing_shuffles(self.spark):
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*df.columns)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Frees tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Frees all tables of the call."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
