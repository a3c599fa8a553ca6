"""A folder for intermediate tables that the caller owns.

Tables that are read more than once are written to storage that every executor
and the driver reach, so that a lost executor costs no recomputation of what
stands before them. Closing the handle removes whatever was written through it.
"""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tripline.session import settings

#: A stored table needs none of the shuffles that made it; without this they stay until the driver collects its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach, or name one")
    return folder.rstrip("/")


class GrowingTable:
    """A stored table that is put together step by step, from at least one.

    Its files are much smaller than their rows in memory, so joins of it must
    not go by their size.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._schema: StructType | None = None

    def add(self, df: DataFrame, order: list[str]) -> None:
        """Write ``df`` beside what is there; neighbours that are equal in ``order`` take little space."""
        self._schema = df.schema
        with settings(self.spark, SHUFFLES_GO):
            df.sortWithinPartitions(*order).write.option("compression", "zstd").mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)


class WorkDir:
    """Stores tables under one new folder; ``close`` (or leaving ``with``) removes the folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.path = f"{folder.rstrip('/') if folder else shared_folder(spark)}/tripline-{uuid4().hex}"
        self._count = 0
        self._paths: dict[str, str] = {}

    @classmethod
    def for_session(cls, spark: SparkSession) -> WorkDir:
        """A folder in the shared one.

        A session whose driver and executors are one process, as in tests, gets
        a temporary folder when it has no shared one.
        """
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not named and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            return cls(spark, tempfile.mkdtemp(prefix="tripline-"))
        return cls(spark)

    def new_path(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:03d}-{name}"

    def store(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write ``df`` and read it back; its size is then known to the planner."""
        path = self.new_path(name)
        with settings(self.spark, SHUFFLES_GO):
            df.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def growing(self, name: str) -> GrowingTable:
        """A new table to which rows are added step by step."""
        self._paths[name] = self.new_path(name)
        return GrowingTable(self.spark, self._paths[name])

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if self.path.split(":", 1)[-1] in path:
                self._delete(path)

    def drop_named(self, name: str) -> None:
        """Remove the table stored last under a name, which nothing reads any more."""
        self._delete(self._paths.pop(name))

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

    def __enter__(self) -> WorkDir:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
