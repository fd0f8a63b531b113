"""Exact largest inner products of integer vectors with vector-approximation files."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.vectors import distinct_rows, search, usable

#: Cells of a dimension.
CELLS = 64
#: Integers up to here add and multiply exactly in double precision.
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def _build(ids: np.ndarray, x: np.ndarray, keep: int) -> bytes:
    """The file of a shard: a cell number of one byte for each component, the cells' edges, and the exact vectors apart."""
    x, ids, at = distinct_rows(ids, x, keep)
    marks = np.quantile(x, np.arange(1, CELLS) / CELLS, axis=0, method="lower")
    cells = np.stack([np.searchsorted(marks[:, d], x[:, d], "right") for d in range(x.shape[1])], 1).astype(np.uint8)
    low, high = np.full((CELLS, x.shape[1]), np.inf), np.full((CELLS, x.shape[1]), -np.inf)
    for d in range(x.shape[1]):
        np.minimum.at(low[:, d], cells[:, d], x[:, d])
        np.maximum.at(high[:, d], cells[:, d], x[:, d])
    return pickle.dumps((cells, low, high, x, ids, at))


def exact_dot(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of integer rows with q, in Python's integers where doubles may round, held to the range of a long."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < EXACT:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(v) for v in q]
    return [min(LONG_MAX, max(LONG_MIN, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x]


def _answer(index: tuple, own: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """The best k of the shard for each query, read in the order of their bounds until no bound reaches the kth.

    Bounds are rounded outwards by more than doubles can err, so rows that
    are not read are worse for certain; ties are read on and go by id.
    """
    cells, low, high, x, ids, at = index
    column = np.arange(x.shape[1])
    copies = np.diff(at)
    least, most = low[cells, column], high[cells, column]
    rows, found, value = [], [], []
    for r, (name, v) in enumerate(zip(own.tolist(), q, strict=True)):
        up, down = np.maximum(v, 0), np.minimum(v, 0)
        slack = 1e-12 * (np.maximum(np.abs(least), np.abs(most)) @ np.abs(v)) if np.abs(v).max() * max(np.abs(x).max(), 1) * len(v) >= EXACT else 0.0
        upper = np.minimum(most @ up + least @ down + slack, -float(LONG_MIN))
        lower = np.clip(least @ up + most @ down - slack, float(LONG_MIN), -float(LONG_MIN))
        # k + 1 candidates of at least this score are there, of which one may be the query itself
        floor = -np.inf
        if copies.sum() > k:
            worth = np.argsort(-lower, kind="stable")
            floor = lower[worth[np.searchsorted(np.cumsum(copies[worth]), k + 1)]]
        order = np.flatnonzero(upper >= floor)
        order = order[np.argsort(-upper[order], kind="stable")]
        best: list[tuple[int, int]] = []
        for start in range(0, len(order), 64):
            if len(best) == k and upper[order[start]] < -best[-1][0]:
                break
            part = order[start : start + 64]
            scores = exact_dot(x[part], v)
            best += [(-s, i) for p, s in zip(part, scores, strict=True) for i in ids[at[p] : at[p + 1]].tolist() if i != name]
            best = sorted(best)[:k]
        rows += [r] * len(best)
        found += [i for _, i in best]
        value += [-s for s, _ in best]
    return np.array(rows, np.int64), np.array(found, np.int64), np.array(value, np.int64)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_size: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest inner product with each row of queries.

    vectors and queries: vec_id long, embedding array of numbers; other
    columns are not read. Components become floor(scale * x) in double
    precision, the score is the integer inner product, exact, the query's own
    row is left out and ties go to the smaller vec_id. Null vectors, those
    with a null or non-finite component (before or after scaling) and rows
    with a null vec_id take no part; zero vectors do. A score beyond the range
    of a long is held at its end. Vectors of different dimension never meet.
    Fewer than k candidates give fewer rows, an empty table none.
    """
    def floors(df: DataFrame) -> DataFrame:
        cast = F.transform("v", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
        return usable(df).select("vec_id", cast.alias("v")).where(~F.exists("v", lambda x: F.abs(x) == float("inf")))

    return search(floors(vectors), floors(queries), lambda i, x: _build(i, x, k + 1), lambda x, i, q: _answer(x, i, q, k), k, shard_size, "long")
