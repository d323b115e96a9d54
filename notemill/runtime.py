"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a session without that setting (a local test) gets a machine-local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="notemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other job uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read to the shared folder, and read it back.

    Later jobs neither recompute it nor depend on the executors that made it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_seen(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """``stage``, with aggregates of the rows taken by the write itself.

    Columns whose names start with ``__`` serve the aggregates only and are not stored. The write's own tasks
    take them, so a task that runs again counts once.
    """
    path, seen = fresh_path(df.sparkSession, name), Observation()
    watched = df.observe(seen, *[value.alias(fact) for fact, value in facts.items()])
    watched.drop(*[c for c in df.columns if c.startswith("__")]).write.parquet(path)
    return df.sparkSession.read.parquet(path), seen.get


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later job reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
