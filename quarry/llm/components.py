"""Connected components of an edge table: nodes hook onto their least neighbour, chains are jumped, ends meet again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, cut, drop_cut, near, rows_of

#: Edges that one task takes to the end at most (16 MB of ids); more go through rounds first.
LOCAL_EDGES = 1_000_000


def least_reachable(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of names that each reaches over the edges of positions (a, b)."""
    rank = np.empty(len(names), np.int64)
    order = np.argsort(names, kind="stable")
    rank[order] = np.arange(len(names))
    end = np.arange(len(names))
    a, b = rank[a], rank[b]
    while len(a):
        a, b = end[a], end[b]
        a, b = np.maximum(a, b), np.minimum(a, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(end, a, b)
        while (end != (nearer := end[end])).any():
            end = nearer
    return names[order][end[rank]]


def _within(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges that come to the task."""
    table = pa.Table.from_batches(list(it), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    edges = np.stack([table.column(c).to_numpy() for c in ("a", "b")])
    names = np.unique(edges)
    found = least_reachable(names, *(np.searchsorted(names, x) for x in edges))
    for batch in pa.table({"node": names, "component": found}).to_batches(max_chunksize=100_000):
        yield batch


def _jumped(held: DataFrame, rounds: int, broadcast_rows: int) -> DataFrame:
    """The cut frame (a, up) with up replaced by the end of its chain; each round halves the chains."""
    for _ in range(rounds):
        up = held.select("a", "up")
        above = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        moved = cut(up.join(near(above, broadcast_rows, held), "up", "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        drop_cut(held)
        held = moved
        if held.where("moved").isEmpty():
            return held
    raise RuntimeError(f"chains are left after {rounds} rounds")


def connected_components(edges: DataFrame, rounds: int = 60, broadcast_rows: int = BROADCAST_ROWS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for each node of edges (a long, b long); component is the smallest node reachable.

    Each round hooks every node that has a smaller neighbour onto the least
    one, follows these hooks to their ends, and goes on with the edges that
    still join different ends, once each: at least half of the nodes that
    have edges are no ends, and stars are done in one round. As soon as at
    most local_edges are left, by count, one task of an executor takes them
    to the end, which bounds its memory. Tables of up to broadcast_rows nodes
    are broadcast; larger ones are joined by shuffle, where Spark splits a hot
    side. Only counts reach the driver, and the files of finished rounds are
    removed. Null ends and loops are ignored, repeated edges count once; an
    empty table gives an empty one.
    """
    ordered = lambda x: x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left, levels = cut(ordered(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))), []
    while rows_of(left, local_edges) > local_edges:
        if len(levels) == rounds:
            raise RuntimeError(f"edges are left after {rounds} rounds")
        ends = _jumped(cut(left.groupBy("a").agg(F.min("b").alias("up"))), rounds, broadcast_rows)
        levels.append(ends)
        of_a, of_b = ends.select("a", "up"), ends.select(F.col("a").alias("b"), F.col("up").alias("end"))
        met = left.join(near(of_a, broadcast_rows, ends), "a").join(near(of_b, broadcast_rows, ends), "b", "left").select(F.col("up").alias("a"), F.coalesce("end", "b").alias("b"))
        done, left = left, cut(ordered(met.where("a <> b")))
        drop_cut(done)
    found = cut(left.coalesce(1).mapInArrow(_within, "node long, component long"))
    drop_cut(left)
    while levels:
        # what hooked lower down gets the component of its end; ends without edges are components of their own
        lower = levels.pop().select(F.col("a").alias("node"), "up")
        top = found.select(F.col("node").alias("up"), F.col("component").alias("top"))
        hooked = cut(lower.join(near(top, broadcast_rows, found), "up", "left").select("node", F.coalesce("top", "up").alias("component")))
        ends = lower.select(F.col("up").alias("node")).distinct().join(near(found.select("node"), broadcast_rows, found), "node", "left_anti").select("node", F.col("node").alias("component"))
        found = cut(found.unionByName(hooked).unionByName(ends))
        drop_cut(hooked)
    return found
