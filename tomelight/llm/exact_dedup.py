"""Exact dedup by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import golomb
from .store import durable, restrict, shards
from .textkit import U64, as_binary

#: Fingerprints that one owner gets at a time, about.
PER_OWNER = 4_000_000


def _fingerprints(batches):
    part = TaskContext.get().partitionId()
    for batch in batches:
        digests = [hashlib.sha256(t).digest() for t in as_binary(batch.column(1)).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], pa.int64()), pa.array([d.hex() for d in digests], pa.string()), pa.array([part] * len(digests), pa.int32())],
            ["id", "fp", "sha", "part"],
        )


def _owner(fps: np.ndarray, owners: int) -> np.ndarray:
    return ((fps >> U64(40)) * U64(owners) >> U64(24)).astype(np.int64)


def _send(owners: int):
    def send(table: pa.Table) -> pa.Table:
        fps, counts = np.unique(table.column("fp").to_numpy().astype(np.int64).view(U64), return_counts=True)
        to = _owner(fps, owners)
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(fps)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        part = table.column("part")[0].as_py()
        coded = [golomb.encode(fps[a:b]) for a, b in spans]
        twice = [golomb.encode(fps[a:b][counts[a:b] > 1]) for a, b in spans]
        return pa.table({"owner": pa.array([int(to[a]) for a, _ in spans], pa.int32()), "part": pa.array([part] * len(spans), pa.int32()), "sent": pa.array(coded, pa.binary()), "twice": pa.array(twice, pa.binary())})

    return send


def _answer(table: pa.Table) -> pa.Table:
    """Of each list, which values occur twice anywhere. A partition sends a value once, however many rows have it."""
    sent = [golomb.decode(x.as_py()) for x in table.column("sent")]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    twice = np.concatenate([values[counts > 1], *(golomb.decode(x.as_py()) for x in table.column("twice"))])
    return pa.table({"part": table.column("part"), "owner": table.column("owner"), "bits": pa.array([np.packbits(np.isin(x, twice)).tobytes() for x in sent], pa.binary())})


def _suspects(owners: int):
    def suspects(rows: pa.Table, answers: pa.Table) -> pa.Table:
        fps, at = np.unique(rows.column("fp").to_numpy().astype(np.int64).view(U64), return_inverse=True)
        to = _owner(fps, owners)
        hit = np.zeros(len(fps), bool)
        for owner, bits in zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            a, b = np.searchsorted(to, [owner, owner + 1])
            hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
        return rows.select(["id", "sha"]).filter(pa.array(hit[at]))

    return suspects


def _texts(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """Texts of the suspects with their hash; repeated ids give each row once."""
    texts = restrict(docs, suspects.select("id").distinct(), "id")
    return texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte by byte; a null text counts as empty. Of equal texts the row
    with the largest id stays (a null id is smaller than any other; a group with null ids only keeps
    keep_id null and all its rows). Rows that repeat an id with one text count each, and all rows
    with the kept id stay. An empty table gives an empty result; other columns are not looked at.

    Each partition sends its sorted fingerprints to their owners in Golomb code and gets a bitmap of
    those that occur twice; only the texts of suspects are shuffled, grouped by the text itself (summed
    up before the shuffle, so a text that a third of the rows share is one row per task there).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = durable(docs.mapInArrow(_fingerprints, f"id {kind}, fp long, sha string, part int"), "fingerprints")
    owners = shards(docs.sparkSession, table.count(), PER_OWNER)
    sent = table.groupBy("part").applyInArrow(_send(owners), "owner int, part int, sent binary, twice binary")
    bits = sent.groupBy("owner").applyInArrow(_answer, "part int, owner int, bits binary")
    suspects = durable(table.groupBy("part").cogroup(bits.groupBy("part")).applyInArrow(_suspects(owners), f"id {kind}, sha string"), "suspects")
    texts = _texts(docs, suspects)
    groups = texts.groupBy("sha", "text").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    groups = groups.groupBy("sha").agg(F.max("keep").alias("keep"), F.max("n").alias("n"), F.count("*").alias("texts"))
    groups = groups.select("sha", "keep", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts with one SHA-256"))).alias("n"))
    out = table.select("id", "sha").join(groups, "sha", "left")
    keep = F.coalesce("keep", "id")
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
