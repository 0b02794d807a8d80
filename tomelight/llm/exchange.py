"""Whole texts in buckets that ask owners about sorted, Golomb-coded fingerprints of what they hold."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import golomb
from .store import durable, restrict, shards
from .textkit import U64, as_binary

#: Fingerprints that one owner gets at a time, about.
PER_OWNER = 4_000_000


def spans(values: np.ndarray, bits: int, owners: int) -> list[tuple[int, int, int]]:
    """(owner, a, b): the runs values[a:b] of sorted fingerprints of so many bits that go to one owner."""
    if not len(values):
        return []
    to = ((values >> U64(bits - 24)) * U64(owners) >> U64(24)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(values)]
    return [(int(to[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def lists(column) -> list[np.ndarray]:
    return [golomb.decode(x.as_py()) for x in column]


def joined(column) -> np.ndarray:
    """All values of some lists, sorted."""
    return np.sort(np.concatenate([np.zeros(0, U64), *lists(column)]))


def member(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array found."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


class Buckets:
    """The distinct texts of a table, dealt to buckets of about `size` bytes by their hash.

    rows: id (null as the least number), sha (of the whole text, null as empty), one for each row of the table.
    texts: bucket, sha, id, many (whether several rows have the text), text; each text once, with its least id.
    Rows are told apart by a 64-bit hash of id and sha, as ids may be null or shared. The one shuffle of texts
    serves all steps that group by bucket.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int):
        docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        docs = docs.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        self.rows = durable(docs.select("id", "sha", F.octet_length("text").alias("n_bytes")), "hashes")
        own = self.rows.groupBy("sha", "id").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"))
        classes = own.groupBy("sha").agg(F.min(F.struct("id", F.col("n").alias("own"))).alias("least"), F.sum("n").alias("n"), F.max("n_bytes").alias("n_bytes"))
        classes = classes.select("sha", "least.id", "least.own", "n", "n_bytes")
        self.classes = durable(classes, "classes")
        self.n_bytes = int(self.classes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
        self.buckets = shards(docs.sparkSession, self.n_bytes, size)
        key = F.xxhash64("id", "sha").alias("key")
        docs = docs.withColumn("key", key)
        once, several, again = (self.classes.where(x).select(key) for x in ("n = 1", "n > 1 and own = 1", "own > 1"))
        parts = [restrict(docs, once, "key").withColumn("many", F.lit(False)), restrict(docs, several, "key").withColumn("many", F.lit(True))]
        if not again.isEmpty():  # rows that repeat id and text: one of each before the shuffle
            parts.append(restrict(docs, again, "key").dropDuplicates(["sha"]).withColumn("many", F.lit(True)))
        bucket = F.pmod(F.xxhash64("sha"), F.lit(self.buckets)).cast("int").alias("bucket")
        self.texts = reduce(DataFrame.unionByName, parts).select(bucket, "sha", "id", "many", "text")

    def spread(self, results: DataFrame) -> DataFrame:
        """results (one row for each sha) for every row of the table."""
        return self.rows.select("id", "sha").join(results, "sha")


def whole(table: pa.Table) -> pa.Table:
    """The rows of a bucket, each text once with its least id, texts as large_binary."""
    if not table.num_rows:
        return table
    table = table.sort_by([("sha", "ascending"), ("id", "ascending"), ("many", "descending")])
    shas = table.column("sha").to_pylist()
    first = [k for k in range(len(shas)) if not k or shas[k] != shas[k - 1]]
    table = table.take(first)
    return table.set_column(table.schema.get_field_index("text"), "text", as_binary(table.column("text")))
