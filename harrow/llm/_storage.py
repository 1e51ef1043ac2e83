"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests on one machine), an own temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='harrow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A folder for the intermediate tables of one job, removed when the driver ends or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_drop)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return it as a table read back, so lost executors repeat no earlier work."""
        df.write.mode("overwrite").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, label: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(label) if label else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quietly_drop(self) -> None:
        with contextlib.suppress(Exception):
            self.drop()
