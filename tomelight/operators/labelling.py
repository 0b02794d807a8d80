"""Sequence labels: BIO decoding and encoding, Viterbi paths, agreement of annotators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

ENTITIES = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


_ENTITIES = pa.list_(pa.struct([("type", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))


#: Rows of tags that are decoded together.
TOGETHER = 256


@F.arrow_udf(ENTITIES)
def bio_entities(tags: pa.Array) -> pa.Array:
    """Entities of BIO tags with their first and last token: I of another type begins a new one, I without an open one is ignored.

    Only different tags become Python's; the tokens of some rows are decoded together."""
    return pa.concat_arrays([pa.array([], _ENTITIES), *(_decoded(tags.slice(k, TOGETHER)) for k in range(0, len(tags), TOGETHER))])


def _decoded(tags: pa.ListArray) -> pa.ListArray:
    sizes, coded = tags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), tags.flatten().dictionary_encode()
    until = np.cumsum(sizes)
    parts = [(x or "O").partition("-") for x in [*coded.dictionary.to_pylist(), None]]
    kinds = sorted({kind for _, _, kind in parts})
    at = coded.indices.fill_null(len(parts) - 1).to_numpy(zero_copy_only=False)
    begins, inside = (np.array([head == x for head, _, _ in parts])[at] for x in "BI")
    kind = np.array([kinds.index(x) for _, _, x in parts], np.int32)[at]
    named, before = begins | inside, np.zeros(len(at), bool)
    before[1:] = named[:-1]
    before[(until - sizes)[sizes > 0]] = False  # the first token of a row has none before
    runs, seen = named & ~before, np.cumsum(begins, dtype=np.int32)
    earlier = np.concatenate([[0], (seen - begins)[runs]])[np.cumsum(runs)]  # B before the run
    opened = named & (seen > earlier)
    other = np.ones(len(at), bool)
    other[1:] = kind[1:] != kind[:-1]  # in an open run the token before has the type of the open entity
    starts = opened & (begins | other)
    ends = opened.copy()
    ends[:-1] &= ~(opened[1:] & ~starts[1:])
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    row = np.searchsorted(until, first, side="right")
    since = (until - sizes)[row]
    found = [pa.array(kinds, pa.string()).take(pa.array(kind[first])), pa.array(first - since, pa.int32()), pa.array(last - since, pa.int32())]
    counts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(found, ["type", "first", "last"]))


def bio_tags(size: Column, entities: Column) -> Column:
    """The tags of a sequence of `size` tokens, from its entities; the first entity that covers a token names it."""

    def tag(k: Column) -> Column:
        over = F.get(F.filter(entities, lambda e: (e["first"] <= k) & (e["last"] >= k)), F.lit(0))
        return F.when(over.isNull(), "O").otherwise(F.concat(F.when(over["first"] == k, "B-").otherwise("I-"), over["type"]))

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), tag)).otherwise(F.array().cast("array<string>"))


def viterbi(df: DataFrame, emissions: str, transitions: list[list[float]], out: str = "path", start: list[float] | None = None, end: list[float] | None = None) -> DataFrame:
    """df with the best path of labels through emissions (array<array<double>>, tokens by labels); empty for no tokens.

    Scores of starting and ending with a label count too (0 if not given), and a score that is missing is 0.
    Scores are read where Arrow holds them; rows of about one length are decoded together."""
    step, first, last = np.array(transitions, float), start and np.array(start, float), end and np.array(end, float)

    @F.arrow_udf("array<int>")
    def best(rows: pa.Array) -> pa.Array:
        return best_paths(rows, step, first, last)

    return df.withColumn(out, best(F.col(emissions)))


def _scores(tokens: pa.ListArray, kinds: int) -> np.ndarray:
    """The scores of tokens (rows) by labels; those that are null, or that a token lacks, are 0."""
    sizes, flat = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), tokens.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    if (sizes == kinds).all():
        return flat.reshape(len(tokens), kinds)
    row, out = np.repeat(np.arange(len(tokens)), sizes), np.zeros((len(tokens), kinds))
    kind = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]
    known = kind < kinds
    out[row[known], kind[known]] = flat[known]
    return out


def best_paths(rows: pa.ListArray, step: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> pa.ListArray:
    """The path of each row of emissions (see viterbi); no value becomes a Python object."""
    start, end = (np.zeros(len(step)) if x is None else x for x in (start, end))
    tokens = rows.flatten()  # null rows have no tokens
    scores = _scores(tokens, len(step))
    sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    paths = np.zeros(len(tokens), np.int32)
    at = np.flatnonzero(sizes)
    for some, x, size in _padded([scores[ends[k] - sizes[k] : ends[k]] for k in at]):
        found = _paths(x, size, step, start, end)
        for row, k in enumerate(at[some]):
            paths[ends[k] - sizes[k] : ends[k]] = found[row, : sizes[k]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(paths))


#: Numbers that the padded scores of some rows may take together.
PADDED = 1 << 20


def _padded(rows: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, scores, lengths) of some rows of about one length at a time, padded to the longest of them."""
    order, some = sorted(range(len(rows)), key=lambda k: len(rows[k])), []
    for k in order:
        if some and (len(some) + 1) * rows[k].size > PADDED:
            yield some, *_stack([rows[j] for j in some])
            some = []
        some.append(k)
    if some:
        yield some, *_stack([rows[j] for j in some])


def _stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), size.max(), rows[0].shape[1]))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, size


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _paths(x: np.ndarray, size: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best paths of padded rows; of equally good ones, that whose last differing label is the least."""
    n, length, kinds = x.shape
    best, back = start + x[:, 0], np.zeros((n, length, kinds), np.int32)
    for t in range(1, length):
        both = best[:, :, None] + step
        back[:, t] = both.argmax(axis=1)
        best = np.where((t < size)[:, None], both.max(axis=1) + x[:, t], best)
    path = np.zeros((n, length), np.int32)
    at = (best + end).argmax(axis=1)
    for t in range(length - 1, -1, -1):
        path[:, t] = at
        at = np.where((t < size) & (t > 0), np.take_along_axis(back[:, t], at[:, None], 1)[:, 0], at)
    return path


def _decode(x: np.ndarray, size: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths, and how likely each of their labels is given all paths (forward and backward sums), of padded rows."""
    length = x.shape[1]
    ahead = np.empty_like(x)
    ahead[:, 0] = start + x[:, 0]
    for t in range(1, length):
        ahead[:, t] = np.where((t < size)[:, None], _log_sum(ahead[:, t - 1, :, None] + step, 1) + x[:, t], ahead[:, t - 1])
    behind = np.empty_like(x)
    behind[:, -1] = end
    for t in range(length - 2, -1, -1):
        onward = _log_sum(step + (x[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where((t + 1 < size)[:, None], onward, end)
    path = _paths(x, size, step, start, end)
    total = _log_sum(ahead[:, -1] + end, 1)  # past its end a row keeps its last sums
    sure = np.exp(np.take_along_axis(ahead + behind, path[:, :, None], 2)[:, :, 0] - total[:, None])
    return path, sure


def crf_decode(df: DataFrame, emissions: str, transitions: list[list[float]], start: list[float], end: list[float]) -> DataFrame:
    """df with path (array<int>) and confidence (array<double>): the best labels of the tokens and the share of all paths that has each.

    Scores of starting and ending with a label count too. Rows of an Arrow batch are decoded together, padded. Null and
    empty rows have empty arrays; of equally good paths the one whose last differing label is the least.
    """
    step, first, last = np.array(transitions, float), np.array(start, float), np.array(end, float)

    @F.pandas_udf("path array<int>, confidence array<double>")
    def decoded(rows: pd.Series) -> pd.DataFrame:
        found = [np.array([list(x) for x in r], float) if r is not None and len(r) else None for r in rows]
        at = [k for k, r in enumerate(found) if r is not None]
        paths, sure = [[] for _ in found], [[] for _ in found]
        for some, x, size in _padded([found[k] for k in at]):
            p, c = _decode(x, size, step, first, last)
            for row, k in enumerate(some):
                paths[at[k]], sure[at[k]] = p[row, : size[row]].tolist(), c[row, : size[row]].tolist()
        return pd.DataFrame({"path": paths, "confidence": sure})

    return df.withColumn("__found", decoded(F.col(emissions))).select(*df.columns, "__found.path", "__found.confidence")


def softmax(x: Column) -> Column:
    """Softmax of an array, shifted by its largest entry."""
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda s, w: s + w))
