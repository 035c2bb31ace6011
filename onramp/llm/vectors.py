"""Vectors with integer components, as whole-valued doubles, for operators 8 and 13."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = int(np.iinfo(np.int64).max)   # stands for a null id: comes last among ties
LOW = int(np.iinfo(np.int64).min)     # no score yet
EXACT = 2.0**53                       # doubles below are exact as whole numbers


def complete(v: Column) -> Column:
    """The array is not null and all its components are finite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(v: Column, factor: float) -> Column:
    """floor(factor * x) of every component; doubles from 2^53 on have no fraction to drop."""
    return F.transform(v, lambda x: F.when(F.abs(x * factor) < EXACT, F.floor(x * factor).cast("double")).otherwise(x * factor))


def matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """One row per vector, missing components zero; at least ``width`` columns."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), max([width, 1, *lengths[:1], lengths.max(initial=0)])))
    if len(lengths) and (lengths == out.shape[1]).all():
        return flat.reshape(out.shape)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows as longs: in doubles where no partial sum can reach
    2^53, in longs below 2^62, else in whole numbers of any size (only for the rows that need
    it). A product that no long can hold raises ``OverflowError``."""
    width = max(q.shape[1], x.shape[1])
    q, x = widened(q, width), widened(x, width)
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    qm, xm = np.abs(q).max(axis=1), np.abs(x).max(axis=1)
    most = float(qm.max()) * float(xm.max()) * width
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62 and max(qm.max(), xm.max()) < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    for rows, largest, other, turn in ((x, xm, q, False), (q, qm, x, True)):
        near = np.zeros(len(rows), bool)
        near[largest <= 2.0**20] = True
        if near.any() and not near.all():  # the few large rows by themselves
            out = np.zeros((len(q), len(x)), np.int64)
            for some in (near, ~near):
                if turn:
                    out[some] = products(rows[some], other)
                else:
                    out[:, some] = products(other, rows[some])
            return out
    whole = [np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (q, x)]
    exact = whole[0].dot(whole[1].T)
    if any(abs(v) > NO_ID for v in exact.ravel()):
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


def blocks(rows: DataFrame, most_rows: int, most_bytes: int, vector: str = "v") -> Iterator[list]:
    """The rows in blocks of at most ``most_rows`` rows and ``most_bytes`` bytes of components
    (or one row), of which the driver holds one at a time."""
    own, size = [], 0
    for r in rows.toLocalIterator():
        own_size = 8 * len(r[vector])
        if own and (len(own) >= most_rows or size + own_size > most_bytes):
            yield own
            own, size = [], 0
        own.append(r)
        size += own_size
    if own:
        yield own


def as_matrix(vectors: list) -> np.ndarray:
    out = np.zeros((len(vectors), max([1, *map(len, vectors)])))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], ~scores[some]))[:k]]
    return np.lexsort((ids, ~scores))[:k]
