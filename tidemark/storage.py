"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where one process is all."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written as Parquet under the shared folder.

    A written table is the recovery point for lost executors: what follows reads files instead of
    recomputing shuffles, and the shuffle files of the step that wrote it can go at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def files(self, table: str) -> int:
        """How many part files a saved table has."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return sum(f.getPath().getName().startswith("part-") for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))

    def drop(self, *tables: str) -> None:
        for table in tables:
            delete(self.spark, self.path(table))

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the operator's result and drops every other table of this workspace."""
        out = self.save(df, "result")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for entry in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
            if entry.getPath().getName() != "result":
                delete(self.spark, entry.getPath().toString())
        return out


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files go when the action that made them ends."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
