"""A baseline of known tuples that is kept and grows, instead of being learned from the log each time."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.operators.lookups import exclude_possible
from tripline.session import settings


class KnownTuples:
    """Distinct ``(*exact, optional)`` tuples in a bucketed table.

    The table is bucketed by all its columns, so a test for novelty moves
    the new rows to the buckets and never the baseline. ``learn`` appends what is not
    known yet; every append leaves a file per bucket and task, and ``compact``
    brings them back to one per bucket.

    ``name`` is a catalog table, ``path`` the shared folder that holds its files.
    One writer at a time: readers see whole appends, and a compaction writes a new folder
    before the table points to it.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, exact: list[str], optional: str, buckets: int = 200):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        self.exact, self.optional, self.columns = exact, optional, [*exact, optional]
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, df: DataFrame, mode: str, path: str | None = None) -> None:
        # One task per bucket, so that a bucket gets one file per write.
        dealt = df.repartition(self.buckets, *self.columns)
        writer = dealt.write.format("parquet").mode(mode).bucketBy(self.buckets, *self.columns).sortBy(*self.columns)
        (writer.option("path", path) if path else writer).saveAsTable(self.name)

    def learn(self, df: DataFrame) -> None:
        """Add the tuples of ``df`` that are not known; those without ``optional`` are not learned."""
        new = df.where(F.col(self.optional).isNotNull()).select(*self.columns).distinct()
        if self.spark.catalog.tableExists(self.name):
            known = self._renamed(self.rows())
            same = [F.col(name).eqNullSafe(F.col(f"_b_{name}")) for name in self.columns]
            self._write(new.join(known, same, "left_anti"), "append")
        else:
            self._write(new, "errorifexists", f"{self.path}/{uuid4().hex}")

    def _renamed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(name).alias(f"_b_{name}") for name in self.columns])

    def novel(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose tuple is surely not known, by the rule of ``novel_vs_baseline``."""
        known = self.rows()
        complete = self._renamed(known.dropna(subset=self.exact))
        same = [F.col(name) == F.col(f"_b_{name}") for name in self.columns]
        return exclude_possible(df.join(complete, same, "left_anti"), df, known, self.exact, self.optional)

    def compact(self) -> None:
        """One file per bucket again, in a new folder; the old folder can go once no reader uses it any more."""
        folder, aside = f"{self.path}/{uuid4().hex}", f"{self.name}_{uuid4().hex[:8]}"
        # A task reads one bucket and writes it; nothing is shuffled.
        with settings(self.spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
            writer = self.rows().write.format("parquet").bucketBy(self.buckets, *self.columns).sortBy(*self.columns)
            writer.option("path", folder).saveAsTable(aside)
        # Both tables keep their files where they are; only the names change, and the old one goes last.
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {aside}_old")
        self.spark.sql(f"ALTER TABLE {aside} RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {aside}_old")
        self.spark.catalog.refreshTable(self.name)
