"""Connected components by contraction: each step hangs a node's neighbours on the smallest of them."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(frame: DataFrame) -> DataFrame:
    """The frame at a checkpoint in the folder that the session names; cached where it names none."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and (folder := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint() if spark.sparkContext.getCheckpointDir() else frame.cache()


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark removes the shuffle files of finished queries only then. A plan hangs on
    references of two kinds, so one collection isn't enough."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of the links (any orderable type) with the smallest node it can reach.

    Larger neighbours of a node are hung on the smallest of its neighbourhood, then smaller ones, until nothing changes: the
    number of rounds grows with the logarithm of the longest path. Minima are combined before each shuffle, so a hub
    costs no more than its links; links with a null end are left out.
    """
    edges = kept(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        rest = hung.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct())
