"""Session-level helpers: shared scratch tables and size figures.

Intermediate results that are read more than once, or that cut an iterative
plan, are written as Parquet into the folder all executors share
(``spark.checkpoint.dir``).  They survive the loss of an executor, which a
cached or locally checkpointed block doesn't.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private temporary one only where none is set."""
    global _LOCAL_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _LOCAL_DIR is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL_DIR = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, True)
    return f"file://{_LOCAL_DIR}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Named Parquet tables under one folder of the shared directory.

    A table lives until ``drop`` or until the Python process ends: lazily
    evaluated results may still read it after the operator has returned.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marginalia/{purpose}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))

    def clear(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone at interpreter exit
            pass


def parallel(spark: SparkSession) -> int:
    """Parts for work that is heavy for its bytes: the session's shuffle partitions, or its cores if they are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def blocks_for(rows: int, rows_per_block: int) -> int:
    """Hash blocks needed so that one holds about ``rows_per_block`` rows; at least one."""
    return max(1, -(-rows // rows_per_block))


def hot_keys(df: DataFrame, key: str, at_most: int = 1000) -> list:
    """Keys that each hold more than 1/``at_most`` of the rows, so fewer than ``at_most``.

    One partial-aggregated count; the list's length is bounded by its definition
    whatever the size of the data.  Nulls are not keys.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    floor = max(total // at_most, 1)
    return [r[0] for r in counts.where(F.col("n") > floor).select(key).limit(at_most).collect()]


def join_with_hot(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Equi-join where the rows of the ``hot`` keys don't shuffle.

    ``right`` has one row per key, so its part for the hot keys has at most
    ``len(hot)`` rows and is broadcast; the rest is an ordinary shuffled join.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(~is_hot).join(right.where(~is_hot), key, how).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
