"""Quality scores from zstandard dictionaries of good and bad labelled text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textkit import as_binary, give_back

#: Labelled rows of each class that the classifier is fitted on, at most (those with the least hash of their id), and
#: bytes of what they teach. A text that no longer fits is passed over and the next ones are tried.
SAMPLE, SAMPLE_BYTES = 3000, 2 << 20
#: A longer text (in code points) teaches by PIECES pieces spread evenly over the whole of it, of this length together.
LONG, PIECES = 1 << 16, 16
#: Texts of a batch that are unpacked at a time.
TOGETHER = 256
#: Texts much shorter than this many bytes are scored near the share of label 1.
SHORT = 48
#: Bytes that are compressed at a time; for more, zstandard copies the tables of the dictionary instead of reading them in place.
PART = 16 << 10


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = content.ljust(16)
    bits = min(26, max(16, len(content).bit_length()))  # with smaller tables zstandard forgets, or never reads, the front of the content
    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=max(21, bits), hash_log=bits, chain_log=bits - 1, write_checksum=False, write_content_size=False, write_dict_id=False)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


def _dictionary(texts: list[bytes]) -> bytes:
    """The whole of each text."""
    return b"\n".join(texts)


def _size(compressor: zstandard.ZstdCompressor, text: bytes) -> int:
    """The compressed size of the whole text, in parts."""
    return sum(len(compressor.compress(text[a : a + PART])) for a in range(0, max(1, len(text)), PART))


class Books:
    """The compressors of both classes; built once and used for any number of batches."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text: the difference of its compressed sizes over its size, and how far its size lets one trust it."""
        size = np.array([len(t) for t in texts], float)
        weight = size / (size + SHORT)
        less = np.array([_size(self.bad, t) - _size(self.good, t) for t in texts], float) / np.maximum(size, 1)
        return np.stack([less * weight, weight], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float) -> np.ndarray:
    """Weighted logistic regression with a fixed offset, by Newton steps; lightly held to zero."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    offset: float
    weights: list[float]

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        """Scores of texts, by compressors that are built here."""
        books = Books(self.good, self.bad)

        def score(texts: list[bytes]) -> np.ndarray:
            z = self.offset + (books.evidence(texts) * self.weights).sum(axis=1)  # not a matrix product, whose last bit may differ with the batch
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.scorer()(texts)


def _taught(text: str) -> Column:
    """The whole text; of one longer than LONG, pieces from all over it."""
    piece = LONG // PIECES
    at = lambda k: F.floor(k * (F.length(text) - piece) / (PIECES - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(F.col(text), at(k), F.lit(piece)))
    return F.when(F.length(text) > LONG, F.concat_ws("\n", pieces)).otherwise(F.col(text))


def _fitting(rows: list[tuple[int, int]]) -> list[int]:
    """Of (row, bytes) in order, the rows that fit in SAMPLE_BYTES; a row that does not fit keeps no later one out."""
    kept, left = [], SAMPLE_BYTES
    for row, size in rows:
        if size <= left:
            kept.append(row)
            left -= size
    return kept


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most SAMPLE labelled texts and SAMPLE_BYTES of each class.

    Rows without a label or text, and ids with both labels, teach nothing; copies of a row count once. Rows stand in the
    order of a hash, and every other one of each class is in either half of the sample. Sizes are compared by dictionaries
    of the other half, so that calibration never sees a text that is in the dictionary; the final dictionaries hold both
    halves. With fewer than two rows of one class the score of every text is the (smoothed) share of label 1, 0.5 without
    any labels.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    labels = labels.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high").select("id", "y")
    n = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    sample = [labels.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(sample[0].union(sample[1])), "id").select("id", "y", F.xxhash64("id", "text").alias("row"), _taught("text").alias("text"))
    sized = found.select("y", "row", F.octet_length("text").alias("bytes")).distinct()
    kept = [row for y in (0, 1) for row in _fitting([(r.row, r.bytes) for r in sized.where(F.col("y") == y).orderBy("row").limit(SAMPLE).collect()])]  # numbers only
    picked = docs.sparkSession.createDataFrame([(k,) for k in kept], "row long")
    rows = found.join(F.broadcast(picked), "row").select("row", "text", "y").distinct().collect()  # 2 * SAMPLE rows and 2 * SAMPLE_BYTES at most
    own = [[t.encode("utf-8", "surrogatepass") for _, t in sorted((r.row, r.text) for r in rows if r.y == c)] for c in (0, 1)]
    good, bad = (_dictionary(own[c]) for c in (1, 0))
    offset, weights = float(np.log(prior / (1 - prior))), np.zeros(2)
    if min(map(len, own)) > 1:
        halves = [[texts[h::2] for texts in own] for h in (0, 1)]
        books = [Books(_dictionary(half[1]), _dictionary(half[0])) for half in halves]
        x = np.concatenate([books[1 - h].evidence(halves[h][c]) for h in (0, 1) for c in (0, 1)])
        y = np.repeat([0, 1, 0, 1], [len(halves[h][c]) for h in (0, 1) for c in (0, 1)])
        weights = _logistic(x, y.astype(float), (np.array([1 - prior, prior]) * len(y) / np.bincount(y))[y], offset)
    return QualityModel(good, bad, offset, weights.tolist())


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with one more column (replaced if there): the score in 0..1 of each whole text, null and empty texts included."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of SAMPLE_BYTES at most
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def scores(batches):
        score = shared.value.scorer()
        for batch in batches:
            texts = as_binary(batch.column(at))
            found = np.concatenate([score(texts.slice(a, TOGETHER).to_pylist()) for a in range(0, max(1, len(texts)), TOGETHER)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, score_col])
        give_back()

    return docs.mapInArrow(scores, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
