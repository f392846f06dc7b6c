"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import materialize, remove


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one edge, to a root: then the edges are the components. Counted without any hashing."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up")).unionAll(edges.select(F.col("lo").alias("v"), F.lit(0).alias("up")))
    return ends.groupBy("v").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > 1 OR ups = 1 AND low = 0").isEmpty()


def connected_components(edges: DataFrame, label: str = "components") -> tuple[DataFrame, str]:
    """(id, component) of every vertex of ``edges`` (a, b), and the folder that holds the result.

    ``component`` is the least vertex that can be reached. Each round is written to shared storage, so the plan stays
    short and a lost executor loses a round at most; the number of rounds grows with the logarithm of the diameter. The
    driver sees one row a round at most. A hub's edges are joined with one row, which AQE can split.
    """
    spark = edges.sparkSession
    current, held = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), label)
    while not _settled(current):
        both = current.unionAll(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least")).select("lo", F.least("lo", "least").alias("m"))
        large = current.join(least, "lo").select("hi", F.col("m").alias("lo")).filter("hi <> lo").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(lowest, "hi")
        small = joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(lowest.select("hi", F.col("m").alias("lo"))).distinct()
        after, kept = materialize(small, label)
        remove(spark, held)
        held, current = kept, after
    found = current.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(current.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
    return found, held
