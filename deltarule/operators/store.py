"""Intermediate tables in the session's shared checkpoint folder.

Recursion needs its rounds cut from each other. Written Parquet does that, survives lost
executors, and lets a growing relation be a list of paths: a round adds files and never
rewrites what is known.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only if that is unset (as in tests) a temporary one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().get()


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/rules-{uuid.uuid4().hex}"
        self.written = 0

    def write(self, rows: DataFrame) -> tuple[str, int]:
        """The path and the number of rows, both from one job."""
        path = f"{self.folder}/{self.written}"
        self.written += 1
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        return path, int(seen.get["rows"] or 0)

    def read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def size(self, path: str) -> int:
        """Bytes of a table."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()

    def clear(self) -> None:
        """Deletes the tables; results that read them must be stored before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
