"""Tables in the shared folder that cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; that is set to one of our own only where it is unset and all tasks run here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Rounds:
    """Keeps the frame of each round of a loop as a table and removes older ones."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.n = spark, shared_folder(spark, label), 0

    def keep(self, df: DataFrame, last: int | None = None) -> DataFrame:
        """``df``, written and read again; only the ``last`` tables stay if that is given."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{self.n}")
        self.n += 1
        if last is not None and self.n > last:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.n - 1 - last}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n - 1}")
