"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import drop, durable


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of ids. Returns (node, component): the least id that each node of an edge reaches.

    Null ends and loops are left out. Every step ends in a durable table; nothing goes to the
    driver but two sums. Large groups shrink to stars, so no row list of a group is ever built.
    """
    a, b = edges.columns
    edges = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, seen = durable(edges, "edges"), None
    while True:
        new = durable(_stars(_stars(edges, True), False), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = new
        if tuple(now) == seen:
            break
        seen = tuple(now)
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
