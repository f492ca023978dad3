"""Reading input tables and writing intermediate tables to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes and rows in one Arrow batch between Spark and Python: texts may be long, and a batch is held on both sides.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def bound_batches(spark: SparkSession) -> None:
    """Keeps what goes to a Python worker at once below BATCH_BYTES, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and Spark is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="zonewise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one job under the shared folder.

    A written table cuts the lineage: what follows reads files and can be retried after the loss
    of any executor. Tables that later steps no longer read are dropped with ``drop``.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_root(spark)}/zonewise-{job}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
        """The written table; rows of each value of ``by`` have a folder of their own, which can be dropped alone."""
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name), partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of steps whose frames are gone, which it does when the driver's JVM collects garbage."""
        # the scheduler holds on to its last job until the next one
        self.spark.range(1).count()
        gc.collect()
        self.spark._jvm.System.gc()


def once(function):
    """The function so marked that Spark runs it once for each row.

    Filters and join keys that use a function's result are else pushed below it with a second call, which
    runs in the same task: each call of a task has a Python worker of its own, which the executor keeps.
    """
    return function.asNondeterministic()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    name = f"__zw_{stem}"
    while name in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def key_text(name: str) -> Column:
    """An id as text for hashing; a null id counts as empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32(id as text) mod folds."""
    return F.crc32(key_text(id_col).cast("binary")) % folds
