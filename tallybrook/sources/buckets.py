"""State tables in hash buckets: a batch rewrites only the buckets that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "bucket int, version long, buckets int"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketedTable:
    """A table keyed by ``key`` under one path.

    ``data/v=<n>/bucket=<b>`` holds the rows of bucket b as version n wrote them and is never changed; ``manifest/v=<n>`` says, for
    every bucket that has rows, which version holds it. A version counts once its manifest is complete, so readers see whole
    versions only and a batch that fails midway is simply run again. The last ``keep`` versions stay readable; what none
    of them refers to is removed. One writer at a time. Paths go through Spark's file system.

    A bucket is read and written by a few tasks, so take as many buckets as keep one at some 100 MB; ``resize`` changes
    their number. What the driver holds is a row a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, *, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.schema, self.key, self.buckets, self.keep = spark, path.rstrip("/"), schema, key, buckets, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str) -> list[int]:
        root = self._path(folder)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def versions(self) -> list[int]:
        """Versions that are complete."""
        return [v for v in self._names(f"{self.path}/manifest", "v=") if self._fs.exists(self._path(f"{self.path}/manifest/v={v}/_SUCCESS"))]

    def manifest(self, version: int | None = None) -> tuple[dict[int, int], int]:
        """(version of each bucket, number of buckets) of the current or a given version."""
        known = self.versions()
        at = known[-1] if version is None and known else version
        if at is None or at not in known:
            return {}, self.buckets
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={at}").collect()
        return {r.bucket: r.version for r in rows if r.bucket >= 0}, rows[0].buckets

    def bucket_of(self, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(count)).cast("int")

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of the current or a given version, or of some of its buckets."""
        where, _ = self.manifest(version)
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(where.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def update(self, batch: DataFrame, version: int, merge: Merge) -> set[int]:
        """Write version ``version``: in the buckets that the batch's keys fall into, ``merge(current rows, batch)`` instead of the
        rows there; ``merge`` must keep a key's rows under that key. Returns those buckets. A version that is complete
        already is left as it is. A null key falls into a bucket like any other."""
        if version in self.versions():
            return set()
        where, count = self.manifest()
        touched = {r.b for r in batch.select(self.bucket_of(count).alias("b")).distinct().collect()}
        rows = merge(self.read(buckets=touched), batch)
        self._write(rows, version, count, {b: v for b, v in where.items() if b not in touched})
        return touched

    def replace(self, rows: DataFrame, version: int, *, buckets: int | None = None) -> None:
        """Write a version of these rows alone."""
        if version not in self.versions():
            self._write(rows, version, buckets or self.manifest()[1], {})

    def resize(self, buckets: int, version: int) -> None:
        """Write the current rows into another number of buckets, as a version."""
        self.replace(self.read(), version, buckets=buckets)

    def _write(self, rows: DataFrame, version: int, count: int, others: dict[int, int]) -> None:
        folder = f"{self.path}/data/v={version}"
        names = [c.split(" ")[0] for c in self.spark.createDataFrame([], self.schema).columns]
        dealt = rows.select(*names).withColumn("bucket", self.bucket_of(count))
        dealt.repartition(min(count, 200), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        now = others | dict.fromkeys(self._names(folder, "bucket="), version)
        listed = [(b, v, count) for b, v in sorted(now.items())] or [(-1, version, count)]
        self.spark.createDataFrame(listed, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self._clean()

    def _clean(self) -> None:
        """Remove manifests before the last ``keep`` and the buckets that none of the kept refers to."""
        known = self.versions()
        kept = known[-self.keep :]
        used = {(b, v) for k in kept for b, v in self.manifest(k)[0].items()}
        for v in known[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/v={v}"), True)
        for v in self._names(f"{self.path}/data", "v="):
            if v > kept[-1]:
                continue
            for b in self._names(f"{self.path}/data/v={v}", "bucket="):
                if (b, v) not in used:
                    self._fs.delete(self._path(f"{self.path}/data/v={v}/bucket={b}"), True)
            if not self._names(f"{self.path}/data/v={v}", "bucket="):
                self._fs.delete(self._path(f"{self.path}/data/v={v}"), True)
