"""Intermediate tables in the shared folder, removed as soon as nothing reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notemill.runtime import fresh_path


class Scratch:
    """A folder under ``spark.checkpoint.dir`` for the tables of one operator.

    ``table`` writes and rereads: later jobs neither recompute the rows nor depend on
    the executors that made them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = fresh_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later job reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
