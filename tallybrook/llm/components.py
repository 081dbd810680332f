"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.text import discard, stored


def downward(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct (u, v) with u > v; self links and links with a null end are left out."""
    return links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v and u is not null and v is not null").distinct()


def starred(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step of downward links: a node's larger neighbours, then its smaller ones, hang on the
    smallest. The components stay as they are, and a single star comes to hang on its least node at once."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return small.distinct()


def settled(e: DataFrame) -> bool:
    """Whether distinct downward links are stars: each node hangs on one, and on none that hangs itself."""
    ends = e.select(F.col("u").alias("k"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("k"), F.lit(0).alias("up")))
    open_ = ends.groupBy("k").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > 1 or up = 1 and least = 0")
    return open_.agg(F.count("*")).first()[0] == 0


def connected(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with a link to another; component is the smallest id reachable.

    Links are starred until they are stars; the number of steps is about the log of the longest path.  Steps are
    written to the shared folder, so lineage stays short and a lost executor costs one step.  Minima are combined
    before the shuffle; self links and repeated links are harmless, links with a null end are left out.
    """
    spark, made = links.sparkSession, []
    e = stored(downward(links, a=a, b=b), "links", made)
    while not settled(e):
        old, made = made, []
        e = stored(starred(e), "links", made)
        discard(spark, old)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
