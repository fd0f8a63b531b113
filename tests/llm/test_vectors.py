"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.ann import cosine, nearest_neighbours
from quarry.llm.vafile import top_inner_products


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).repartition(3)


def vectors(seed=0, n=900, dim=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[100:260] = x[5]
    rows = [(i, v) for i, v in enumerate(x)]
    odd = [(2000, None), (2050, [None] + [1.0] * (dim - 1)), (2100, [float("nan")] * dim), (2150, [float("inf")] * dim), (2200, [0.0] * dim), (2250, [1.0, 2.0]), (2300, []), (None, [1.0] * dim), (50, x[50])]
    return rows, odd


def best(rows, queries, score, k=5):
    out = []
    for q, v in queries:
        found = sorted(((-score(v, w), i) for i, w in rows if i != q), key=lambda t: t)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_nearest_neighbours(spark):
    rows, odd = vectors()
    df = frame(spark, rows + odd)
    got = nearest_neighbours(df, df.where("vec_id % 50 = 0"), shard_size=200).collect()
    queries = [r for r in rows if r[0] % 50 == 0]
    want = best(rows, queries, lambda a, b: round(float(cosine(a[None], b[None])[0]), 12))
    mine = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(mine & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    assert {r["query_id"] for r in got} == {q for q, _ in queries}
    of = dict(rows)
    assert all(r["score"] == pytest.approx(float(cosine(of[r["query_id"]][None], of[r["vec_id"]][None])[0]), abs=1e-12) for r in got)
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 150] == [(1, 5), (2, 100), (3, 101), (4, 102), (5, 103)]
    assert nearest_neighbours(df.limit(0), df).count() == 0
    assert nearest_neighbours(df.where("vec_id in (0, 1, 50)"), df.where("vec_id = 0")).count() == 2


@pytest.mark.parametrize("size", [1.0, 1e-3, 1e11])
def test_top_inner_products(spark, size):
    rows, odd = vectors(1, 700, 16)
    rows = [(i, np.round(v * size, 2 if size == 1.0 else 9)) for i, v in rows]
    odd = [(i, v) for i, v in odd if i != 50]
    df = frame(spark, rows + odd + [rows[50]])
    got = sorted(tuple(r) for r in top_inner_products(df, df.where("vec_id % 50 = 0"), shard_size=150).collect())
    whole = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in [*rows, (2200, [0.0] * 16)]]
    queries = [r for r in whole if r[0] % 50 == 0]
    held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = best(whole, queries, lambda a, b: held(sum(x * y for x, y in zip(a, b, strict=True))))
    assert [g for g in got if g[0] != 2250] == sorted(want)
    assert top_inner_products(df.limit(0), df).count() == 0
