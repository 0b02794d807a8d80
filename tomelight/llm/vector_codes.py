"""Product codes of vectors: one codebook for each of eight parts, fitted by rounds of exact assignment and whole-number means."""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .store import BROADCAST_IDS, durable

#: Parts of a vector, entries of a codebook, rounds of fitting, and what a component is multiplied by before it is floored.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Twice the relative error of one float32 operation.
UNIT = 2.0**-23
#: A component times SCALE must be below this, as its floor has to be a long.
LIMIT = float(1 << 62)
#: Sums are kept as two numbers, so that no batch overflows: bits of the lower one.
LOW = 31
#: Copies of the errors of a label, if these are too many for a broadcast; rows of one label then go to as many tasks.
SALTS = 32


def _exactly(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As nearest(), by Python's whole numbers, for components whose squares no int64 holds."""
    best, dist = [np.zeros(0, np.int64)], [np.zeros(0, object)]
    for a in range(0, len(x), 1024):
        d = ((x[a : a + 1024].astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(axis=2)
        best.append(d.argmin(axis=1))
        dist.append(d[np.arange(len(d)), best[-1]])
    return np.concatenate(best), np.concatenate(dist)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of x (int64) the nearest row of c, the first one of several, and its squared distance.

    A float32 matrix product gives |c|^2 - 2xc for all pairs. The sum of d products, its inputs and the final difference
    are off by at most (d + 5) roundings of |c|^2 + 2|x||c|, in whatever order the product adds; every entry whose interval
    meets the least upper end is computed again in int64.
    """
    d = x.shape[1]
    top = isqrt((1 << 61) // max(1, d))  # (2 * top)^2 * d fits in int64
    if not len(x) or np.abs(x).max() > top or np.abs(c).max() > top:
        return _exactly(x, c)
    squares = (c * c).sum(axis=1)
    about = squares.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ c.astype(np.float32).T)
    wide = np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None] * np.sqrt(squares.astype(float))
    wide = (d + 6) * UNIT * (squares + 2 * wide)
    may = about - wide <= (about + wide).min(axis=1)[:, None]
    best = may.argmax(axis=1)
    unsure = np.flatnonzero(may.sum(axis=1) > 1)
    if len(unsure):
        row, entry = np.nonzero(may[unsure])
        exact = np.full((len(unsure), len(c)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[unsure[row]] - c[entry]) ** 2).sum(axis=1)
        best[unsure] = exact.argmin(axis=1)  # the first of equal ones
    return best, ((x - c[best]) ** 2).sum(axis=1)


def _parts(column: pa.Array) -> np.ndarray:
    """Vectors of one length as (row, part, position)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), PARTS, -1)


def _sums(x: np.ndarray, index: np.ndarray, found: np.ndarray) -> None:
    """Add to found[entry, position] (number, high, low) the rows of x by their entry."""
    order = np.argsort(index, kind="stable")
    present, start = np.unique(index[order], return_index=True)
    found[present, :, 0] += np.diff(np.append(start, len(order)))[:, None]
    found[present, :, 1] += np.add.reduceat(x[order] >> LOW, start, axis=0)
    found[present, :, 2] += np.add.reduceat(x[order] & ((1 << LOW) - 1), start, axis=0)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the vectors that are kept, as whole numbers.

    Left out are null vectors, those with a null, non-finite or (times SCALE) not representable component, and those that
    cannot be cut into PARTS equal parts of the length that the kept row with the least id has.
    """
    sound = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < LIMIT, F.lit(False)))
    n = F.size(vec_col)
    df = df.where(F.col(vec_col).isNotNull() & sound & (n > 0) & (n % PARTS == 0))
    df = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"))
    first = _least(df, 1).select(F.size("vector")).first()
    return df.where(F.size("vector") == (first[0] if first else 0))


def _least(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(n)


def fit_codebooks(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks as (part, entry, position) after some rounds over all vectors; they start as the vectors of least id.

    A task of a round returns counts and sums of its rows by part, entry and position, however many rows it has; the
    driver sees the codebooks only. Rounds that would change nothing more are left out. No vectors: no entries.
    """
    start = [r.vector for r in _least(vectors, entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), PARTS, -1 if start else 0).transpose(1, 0, 2)
    for _ in range(rounds if start else 0):
        sums = vectors.select("vector").mapInArrow(_round(books), "part int, entry int, place int, n long, high long, low long")
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        new = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(wide("n"), wide("high"), wide("low")).collect():  # the size of the codebooks at most
            new[r.part, r.entry, r.place] = ((int(r.high) << LOW) + int(r.low)) // int(r.n)
        if (new == books).all():
            break
        books = new
    return books


def _round(books: np.ndarray):
    def run(batches):
        found = np.zeros((*books.shape, 3), np.int64)
        for batch in batches:
            x = _parts(batch.column(0))
            for p in range(PARTS if len(x) else 0):
                _sums(x[:, p], nearest(x[:, p], books[p])[0], found[p])
        at = np.nonzero(found[..., 0])
        yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in at), *(pa.array(found[(*at, k)]) for k in range(3))], ["part", "entry", "place", "n", "high", "low"])

    return run


def encode_vectors(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): the entries nearest to each part as two hex digits each, and the sum of their squared distances (null if no long holds it)."""

    def run(batches):
        for batch in batches:
            x = _parts(batch.column("vector"))
            found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex()
            error = sum(f[1].astype(object) for f in found)
            error = [e if e < 1 << 63 else None for e in error]
            width = 2 * PARTS
            codes = [codes[k : k + width] for k in range(0, len(codes), width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())]))


def _with_label_error(coded: DataFrame) -> DataFrame:
    """One more column, the errors summed over rows of the same label. Sums of few labels are broadcast, else the labels are salted."""
    sums = durable(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "own")
    same = F.col("label").eqNullSafe(F.col("own"))
    if sums.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return coded.join(F.broadcast(sums), same, "left").drop("own")
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    coded = coded.withColumn("row_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return coded.join(sums, same & (F.col("row_salt") == F.col("salt")), "left").drop("own", "salt", "row_salt")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Per kept vector (see whole_vectors) its code, its error, that of all vectors with its label (nulls together), and a digest of the codebooks.

    Rows are vectors of their own, whatever ids they share; of equal ids the least vector comes first. Other columns of
    df are not read. With fewer vectors than entries the codebooks have as many; with none, there are no rows.
    """
    vectors = whole_vectors(df, id_col, vec_col, label_col)
    books = fit_codebooks(vectors, rounds, entries)
    out = _with_label_error(durable(encode_vectors(vectors, books), "codes"))
    digest: Column = F.lit(books_digest(books)).alias("codebooks_sha256")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", digest)
