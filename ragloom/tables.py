"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or the context's checkpoints; one of its own only for a local session where neither is set."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ragloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Tables:
    """Parquet tables of one call; a lost executor's part is read again from there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/ragloom-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, k: int | None = None) -> None:
        """Delete the k-th table, from 1, or all."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{k}" if k else self.root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
