"""Joins, dedupe, top-k and set operators as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each group, with their rank. order must be total. Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each group: the first in a total order."""
    return top_k(df, keys, order, 1, "__rn").drop("__rn")


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, other: str, days: int) -> DataFrame:
    """Pairs with equal keys whose times are at most `days` apart, by an equi-join on time buckets.

    Each right row is sent to the buckets of `days` that its range touches, three at most, so a key with many rows is
    dealt over its times and pairs are compared only with neighbours."""
    width = days * 86_400
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)
    a = left.withColumn("__bucket", bucket(at))
    b = right.withColumn("__bucket", F.explode(F.array(*(bucket(other) + k for k in (-1, 0, 1)))))
    gap = F.abs(F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.col(other).cast("timestamp")))
    return a.join(b, [key, "__bucket"]).where(gap <= width).drop("__bucket")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target and those new rows whose key it does not have."""
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti"))


def upsert_add(target: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of both by key, their sums added."""
    return target.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def zero_filled(counts: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """A row for every name, 0 where counts has none."""
    return names.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def match_cascade(wanted: DataFrame, known: DataFrame, clauses: list[list[str]], target: str, clause: str) -> DataFrame:
    """wanted with the least target of the first clause (columns that must be equal) that finds any, and that clause's number; null if none does.

    One left join a clause, against one row for each key, so rows never multiply."""
    for k, on in enumerate(clauses):
        wanted = wanted.join(known.groupBy(*on).agg(F.min(target).alias(f"__{k}")), on, "left")
    found = [F.col(f"__{k}") for k in range(len(clauses))]
    number = F.coalesce(*(F.when(c.isNotNull(), k) for k, c in enumerate(found)))
    return wanted.withColumns({target: F.coalesce(*found), clause: number}).drop(*(f"__{k}" for k in range(len(clauses))))
