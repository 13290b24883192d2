"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges stay in Spark throughout; each round is a grouped minimum and an equi-join, written to the
shared checkpoint folder. A hot centre is one key of a sort-merge join, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges -> (node, label), label the smallest node of the component; only nodes with an edge.

    Self loops, repeated edges and either direction are fine; edges with a null end are left out.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    e = written(e, "edges")
    was = _state(e)
    while was[0]:
        e = written(_stars(_stars(e, True), False), "stars")
        now = _state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
