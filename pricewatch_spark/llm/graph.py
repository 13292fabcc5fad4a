"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """edges (a, b) of longs -> (id, component): the smallest id reachable, for ids with an edge.

    Every round rewrites the edges towards smaller ids and is written to the shared folder; the
    edges end as stars around the smallest ids.  Only counts and sums come to the driver.
    """
    # rewriting keeps one edge less than members a component, so the number of rows never grows
    current = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    measure = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, step = measure(current), 0
    while before[0]:
        both = current.union(current.select("v", "u"))
        smallest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select("v", "u", "m")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        step += 1
        following = scratch.write(after.distinct(), f"{name}-{step}")
        now = measure(following)
        scratch.drop(f"{name}-{step - 1}")
        current = following
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
