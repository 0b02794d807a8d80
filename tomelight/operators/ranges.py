"""Ranges of whole numbers: overlaps between two tables, and repair of overlapping neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def overlap_join(left: DataFrame, right: DataFrame, key: str, first: str, last: str, width: int, rule: str = "true") -> DataFrame:
    """Pairs of ranges with equal keys that share a number, with the shared part: key, since, until and both sides' rows (l, r).

    Each range is sent to the buckets of `width` numbers that it touches; a pair counts in the bucket where its shared
    part begins, so it appears once and a key with many ranges is dealt over them. rule is a condition over l and r.
    Null keys and bounds, and ranges that end before they begin, join nothing."""

    def side(df: DataFrame, name: str) -> DataFrame:
        bucket = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
        rows = df.where(F.col(first) <= F.col(last)).select(key, F.struct(*df.columns).alias(name), F.explode(bucket).alias("__bucket"))
        return rows

    pairs = side(left, "l").join(side(right, "r"), [key, "__bucket"]).where(F.expr(rule))
    pairs = pairs.withColumns({"since": F.greatest(f"l.{first}", f"r.{first}"), "until": F.least(f"l.{last}", f"r.{last}")})
    return pairs.where((F.col("since") <= F.col("until")) & (F.floor(F.col("since") / width) == F.col("__bucket"))).drop("__bucket")


def trim_overlaps(df: DataFrame, key: str, first: str, last: str, tie: str) -> DataFrame:
    """Ranges of each key in order of their first number, each begun after all before it end; those left empty go.

    Repairing one by one gives the same: a range that goes ends no later than those before it."""
    before = Window.partitionBy(key).orderBy(first, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(first, F.greatest(F.col(first), F.max(last).over(before) + 1)).where(F.col(first) <= F.col(last))
