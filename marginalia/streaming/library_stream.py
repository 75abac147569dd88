"""New files of the library as a stream, handled in restartable batches.

A file stream sees additions only.  Deletions and renames come from the batch plan
(:mod:`marginalia.operators.sync`), which compares whole listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root).withColumn("digest", F.sha2("content", 256))


def run_available(files: DataFrame, prepare: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Prepares all files not seen before and ends.

    A batch writes into a folder named by its number and overwrites it, so a batch run again after a crash
    leaves no doubles; contents prepared in an earlier batch are left out.
    """
    spark = files.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        once = df.dropDuplicates(["digest"])
        try:
            done = spark.read.option("basePath", target).parquet(f"{target}/batch=*").where(F.col("batch") < number).select("digest").distinct()
            once = once.join(done, "digest", "left_anti")
        except Exception as e:  # noqa: BLE001 - nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        prepare(once).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
