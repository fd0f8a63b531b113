"""Vectors as rows of shards, packed for NumPy, and the merge of the shards' answers."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Queries of a block: what one shard is asked at a time; blocks that one task asks of a shard.
BLOCK, GROUP = 1024, 16


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v array<double>, of the rows without a null id, vector or component or a component that isn't finite."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", bad) & (F.size("v") > 0))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column whose rows have dim values each, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def distinct_rows(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of x (m of them), and all ids grouped by row: the `keep` least of each, with m + 1 offsets.

    A search for the nearest k never needs more than the k + 1 least ids of
    equal vectors: ties go to the smaller id and only the query itself is left out.
    """
    _, inverse = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, inverse.ravel()))
    groups = inverse.ravel()[order]
    again = np.concatenate([[False], (groups[1:] == groups[:-1]) & (ids[order[1:]] == ids[order[:-1]])])
    order, groups = order[~again], groups[~again]
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    kept = order[rank < keep]
    return x[order[first]], ids[kept], np.concatenate([[0], np.cumsum(np.minimum(np.diff(np.append(first, len(order))), keep))])


def search(vectors: DataFrame, queries: DataFrame, build: Callable, answer: Callable, k: int, shard_size: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query over all shards, ties to the smaller vec_id.

    vectors and queries: (vec_id, v). build(ids, x) packs a shard's index into
    pickled bytes, once; answer(index, ids, q) gives (position of the query,
    vec_id, score) of what a shard finds for a block of queries. Shards hold
    about shard_size vectors of one dimension, dealt by a hash of the id; each
    block of queries meets each shard of its dimension, as packed rows. A task
    holds one shard and GROUP blocks, whatever the size of the tables. Repeated rows count once; of an id with several vectors the best pair counts.
    """
    sized = vectors.withColumn("dim", F.size("v"))
    counts = {r["dim"]: r["n"] for r in sized.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asked = {r["dim"]: r["n"] for r in queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    kind = "double" if score == "double" else "long"
    plan = [(d, max(1, math.ceil(n / shard_size)), max(1, math.ceil(asked.get(d, 0) / BLOCK))) for d, n in sorted(counts.items()) if asked.get(d)]
    if not plan:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    shards = {d: s for d, s, _ in plan}
    blocks = {d: b for d, _, b in plan}
    table = lambda x: F.create_map(*(F.lit(v) for kv in x.items() for v in kv))[F.col("dim")]  # noqa: E731  one entry for each dimension
    placed = sized.where(F.col("dim").isin(list(shards))).withColumn("shard", F.pmod(F.xxhash64("vec_id"), table(shards)))

    def pack(x: pa.Table) -> pa.Table:
        dim = x.column("dim")[0].as_py()
        ids, m = x.column("vec_id").to_numpy(), matrix(x.column("v"), dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([x.column("shard")[0].as_py()], pa.int64()), "index": pa.array([build(ids, m)], pa.binary())})

    index = cut(placed.groupBy("dim", "shard").applyInArrow(pack, "dim int, shard long, index binary"))
    lined = queries.withColumn("dim", F.size("v")).where(F.col("dim").isin(list(blocks))).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), table(blocks)))

    def block(x: pa.Table) -> pa.Table:
        dim = x.column("dim")[0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([x.column("block")[0].as_py()], pa.int64()), "ids": pa.array([x.column("vec_id").to_numpy().tobytes()], pa.binary()), "q": pa.array([matrix(x.column("v"), dim).tobytes()], pa.binary())})

    blocked = lined.groupBy("dim", "block").applyInArrow(block, "dim int, block long, ids binary, q binary")
    # a shard's index meets GROUP blocks in a task, and is opened once for them
    each = F.sequence(F.lit(0).cast("long"), table(shards).cast("long") - 1)
    groups = F.sequence(F.lit(0).cast("long"), F.floor((table(blocks) - 1) / GROUP).cast("long"))
    key = ["dim", "shard", "group"]
    asked_of = blocked.select("dim", F.floor(F.col("block") / GROUP).cast("long").alias("group"), "ids", "q", F.explode(each).alias("shard"))
    held_by = index.withColumn("group", F.explode(groups))

    def ask(blocks: pa.Table, held: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64() if kind == "double" else pa.int64())})]
        for packed in held.column("index").to_pylist() if blocks.num_rows else []:
            opened = pickle.loads(packed)
            dim = held.column("dim")[0].as_py()
            for i in range(blocks.num_rows):
                ids = np.frombuffer(blocks.column("ids")[i].as_py(), np.int64)
                at, found, value = answer(opened, ids, np.frombuffer(blocks.column("q")[i].as_py(), np.float64).reshape(len(ids), dim))
                out.append(pa.table({"query_id": ids[at], "vec_id": found, "score": pa.array(value, out[0].schema.field("score").type)}))
        return pa.concat_tables(out)

    answered = asked_of.groupBy(*key).cogroup(held_by.groupBy(*key)).applyInArrow(ask, f"query_id long, vec_id long, score {kind}")
    found = answered.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
