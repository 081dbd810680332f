"""State tables as versioned Parquet snapshots: plain Parquet has no row-level upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """A table under one path: ``v=<n>`` folders, the highest complete one being current.

    A version is complete when Spark's _SUCCESS marker is there, so readers never see half a write, and a repeated
    batch id writes the same version again. Paths go through Spark's file system, remote ones too.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        found = [s.getPath() for s in self._fs.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and self._fs.exists(self._path(p, "_SUCCESS")))

    def read(self, below: int | None = None) -> DataFrame:
        """The current rows, or those of the last version before ``below``."""
        usable = [v for v in self.versions() if below is None or v < below]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/v={usable[-1]}") if usable else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")


def scan_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
