"""MinHash fingerprints of texts, their likeness, and near copies by bands of the fingerprints."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import durable
from .textkit import U64, as_binary, byte_hashes, chunks, combine, inside, lower, mix, ngram_hashes, run_hashes, words

#: Words of a shingle, permutations, bytes of a text that are hashed together.
SHINGLE, PERMUTATIONS, RUN = 5, 128, 1 << 20
#: Bands of a fingerprint and values of a band: of pairs with a similarity of 0.8, 5 in 100,000 share no band.
BANDS, VALUES = 25, 5
#: The universal hashes x -> a * x + b modulo 2^64, whose order is that of their high bits.
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=U64)) | U64(1)
_B = mix(np.arange(PERMUTATIONS + 1, 2 * PERMUTATIONS + 1, dtype=U64))
#: The fingerprint of a text without words.
NOTHING = 0xFFFF


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts, shingles of each): n words, A-Z in lower case; of fewer words the whole sequence, of none nothing."""
    data = lower(data)
    start, end, first = words(data, offsets)
    hashes = byte_hashes(data, start, end)
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(int(size.sum()), U64)
    few = (count > 0) & (count < n)
    at = np.cumsum(size) - size
    alone = np.zeros(len(out), bool)
    alone[at[few]] = True
    out[alone] = run_hashes(hashes, first[:-1][few], first[1:][few])
    out[~alone] = ngram_hashes(hashes, n)[inside(first, n)]
    return out, size


def signatures(column, n: int = SHINGLE) -> np.ndarray:
    """Per text of an Arrow column, 16 bits of the least value of its shingles under each permutation."""
    out = np.full((len(column), PERMUTATIONS), NOTHING, np.uint16)
    for a, b, data, offsets in chunks(column, RUN):
        grams, size = shingles(data, offsets, n)
        rows = np.flatnonzero(size)
        if not len(rows):
            continue
        starts = (np.cumsum(size) - size)[rows]
        values = np.empty_like(grams)
        for k in range(PERMUTATIONS):
            np.multiply(grams, _A[k], out=values)
            values += _B[k]
            out[a + rows, k] = mix(np.minimum.reduceat(values, starts)) >> U64(48)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal values of two rows of fingerprints each: about the Jaccard similarity of the shingle sets."""
    return (x == y).mean(axis=1)


def _texts(signs: np.ndarray) -> list[str]:
    """Fingerprints in hex, each value's high digits first."""
    raw, width = signs.astype(">u2").tobytes().hex(), 4 * PERMUTATIONS
    return [raw[k : k + width] for k in range(0, len(raw), width)]


def edit(text: str, other: str) -> str:
    """text whose last half (rounded down, in code points) is the first as many code points of other, or all there are."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def _bounds(keys: DataFrame) -> list[tuple]:
    """Ends of ranges of about equally many keys, all of them keys that occur; one for each shuffle partition at most."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(parts, *keys.columns)
    last = dealt.groupBy(F.spark_partition_id()).agg(F.max(F.struct(*keys.columns)).alias("key"))
    return sorted({tuple(r.key) for r in last.collect()})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its length and fingerprint, those of its edited text, and how like the fingerprints of both and of the next document are.

    The next document comes by descending id, null ids last, and after the last one the first; rows with one id stand by
    a hash of their text. A lone document is its own next. Ids are dealt in ranges, and the last row of a range is sent
    to the range above it too, so texts are moved once and no task sees the whole order. Null texts are empty; empty texts
    have one fingerprint, like themselves. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("told", F.xxhash64("text"))
    bounds = _bounds(rows.select("known", "id", "told"))
    dealt = rows.select("known", "id", "told", "text").mapInArrow(_signed(bounds), "part int, own boolean, known boolean, id long, told long, text string, signs binary")
    dealt = dealt.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", "own", "known", "id", "told")
    kinds = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("own", "known", "id", "text", "signs").mapInArrow(_compared(kinds), kinds)


def _signed(bounds: list[tuple]):
    """Adds fingerprints and the range of each row; the last row of a range goes, not as its own, to the range above, from the highest one to the lowest."""

    def run(batches):
        sent = set()
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            part = [bisect_left(bounds, k) for k in keys]
            signs = signatures(batch.column(3)).view(np.uint8).reshape(len(keys), -1)
            signs = pa.array([s.tobytes() for s in signs], pa.binary())
            more = []
            for at, (p, key) in enumerate(zip(part, keys, strict=True)):
                if key == bounds[p] and p not in sent:
                    sent.add(p)
                    more.append(at)
            for own, picked, to in ((True, None, part), (False, pa.array(more, pa.int64()), [(part[k] + 1) % len(bounds) for k in more])):
                columns = [*batch.columns, signs] if picked is None else [c.take(picked) for c in [*batch.columns, signs]]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([own] * len(to), pa.bool_()), *columns], ["part", "own", "known", "id", "told", "text", "signs"])

    return run


def _compared(kinds: str):
    names = [k.split(" ")[0] for k in kinds.split(", ")]

    def run(batches):
        last = None
        for batch in batches:
            own, known, ids, texts, signs = (c.to_pylist() for c in batch.columns)
            before, edited, keep = [], [], []
            for k, mine in enumerate(own):
                if mine:
                    before.append(last[1])
                    edited.append(edit(texts[k], last[0]))
                    keep.append(k)
                last = texts[k], signs[k]
            read = lambda raw: np.frombuffer(b"".join(raw), np.uint16).reshape(-1, PERMUTATIONS)
            mine, after = read([signs[k] for k in keep]), signatures(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] if known[k] else None for k in keep], pa.int64()), pa.array([len(texts[k]) for k in keep], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(_texts(mine), pa.string()), pa.array(_texts(after), pa.string()),
                pa.array(likeness(mine, after), pa.float64()), pa.array(likeness(mine, read(before)), pa.float64()),
            ], names)

    return run


def _indexed(docs: DataFrame) -> DataFrame:
    """(id, set, bands) of texts with words: sorted distinct shingles and a hash of each band of the fingerprint."""

    def run(batches):
        for batch in batches:
            signs = signatures(batch.column(1))
            sets, size = [], []
            for _, _, data, offsets in chunks(batch.column(1), RUN):
                grams, own = shingles(data, offsets)
                sets += np.split(grams.view(np.int64), np.cumsum(own)[:-1])
            keep = [k for k, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(signs), BANDS), U64)
            for k in range(BANDS):
                bands[:, k] = U64(k)
                for j in range(VALUES):
                    bands[:, k] = combine(bands[:, k], signs[:, k * VALUES + j].astype(U64))
            bands = bands.view(np.int64)
            listed = lambda x: pa.array([*x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), listed(np.unique(sets[k]) for k in keep), listed(bands[k] for k in keep)], ["id", "grams", "bands"])

    return docs.mapInArrow(run, "id long, grams array<long>, bands array<long>")


def near_copies(docs: DataFrame, queries: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, jaccard): documents that share num/den of their shingles with a row of queries, a stated set of the documents.

    Equal texts are one row, of the least id, on either side; copies are found by their text. Bands of both are joined, a
    pair that shares several is looked at once, and the sets themselves decide. Null ids and texts without words are in
    no pair. Of pairs at the bound 5 in 100,000 share no band.
    """

    def of(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        one = one.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
        least = one.groupBy("sha").agg(F.min("id").alias("id"))  # no text is shuffled for this
        return durable(_indexed(one.join(least, ["sha", "id"], "left_semi").dropDuplicates(["id", "sha"]).select("id", "text")), name)

    left, right = of(queries, "asked"), of(docs, "indexed")
    pairs = left.select(F.col("id").alias("query_id"), F.explode("bands").alias("band")).join(right.select("id", F.explode("bands").alias("band")), "band")
    pairs = pairs.where("query_id <> id").select("query_id", "id").distinct()
    pairs = pairs.join(left.select(F.col("id").alias("query_id"), F.col("grams").alias("asked")), "query_id").join(right.select("id", "grams"), "id")
    both = F.size(F.array_intersect("asked", "grams"))
    every = F.size("asked") + F.size("grams") - both
    return pairs.where(both * den >= every * num).select("query_id", "id", (both / every).alias("jaccard"))
