"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, materialize, released


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, root of every node of edges(a, b): root is the least node of its component.

    Each round links nodes to the least of their neighbourhood (large star to greater neighbours, small star
    to smaller ones) until the edge set stays as it is; a hot node's minimum is a map-side aggregate and its links
    join row by row. Rounds are written to the shared folder. Nulls are left out; repeats and loops do not count."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct()
    e = materialize(e, name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, e = e, released(materialize(small.filter("u <> v").distinct(), name))
        dropped(before)
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (row["n"], row["s"]):
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = (row["n"], row["s"])
