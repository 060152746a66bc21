"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..sources.shared import shared_dir

#: Deletes an execution's shuffle files at its end; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named Parquet tables below one fresh folder. ``save`` cuts lineage; the files outlive lost executors.

    A saved table needs the shuffle files that it was made from no longer, so that these go with the end of ``save``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.dir, self.n = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.dir}/{name}-{self.n}"

    def save(self, df: DataFrame, name: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
        """by: columns that the table's folders are made of."""
        path, before = self.path(name), self.spark.conf.get(SHUFFLES_GO, "false")
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def measured(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """A saved table, and aggregates of its rows that are taken while they are written."""
        seen = Observation()
        out = self.save(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
        return out, seen.get

    def drop(self, *saved: DataFrame) -> None:
        """Deletes saved tables that nothing reads any more."""
        for df in saved:
            self._delete(df.scratch_path)

    def clear(self) -> None:
        """Deletes all that was saved here."""
        self._delete(self.dir)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
