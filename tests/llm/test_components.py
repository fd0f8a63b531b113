"""Connected components and the packed numbers of the n-gram Jaccard join."""

import random

import numpy as np
import pytest

from quarry.llm.common import packed, unpacked
from quarry.llm.components import connected_components


def brute(edges):
    least = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            least |= {a: min(a, least.get(a, a)), b: min(b, least.get(b, b))}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    return least


KINDS = ["path", "star", "random", "empty", "odd"]


@pytest.mark.parametrize(("kind", "broadcast_rows", "local"), [*((k, 1000, 100) for k in KINDS), ("random", 0, 5), ("random", 1000, 0), ("path", 1000, 0), ("star", 0, 0)])
def test_components(spark, kind, broadcast_rows, local):
    r = random.Random(7)
    edges = {
        "path": [(i, i + 1) for i in range(40)],
        "star": [(i, 0) for i in range(1, 60)] + [(i, 100) for i in range(101, 130)],
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)],
        "empty": [],
        "odd": [(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (5, 4), (-9, 5)],
    }[kind]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), broadcast_rows=broadcast_rows, local_edges=local).collect()
    assert len(got) == len({x[0] for x in got})
    assert {x["node"]: x["component"] for x in got} == brute(edges)


@pytest.mark.parametrize("values", [[0], [5, 5], [-3, 260, 7], [2**62, -(2**62)], [-(2**63), 2**63 - 1]])
def test_packed(values):
    x = np.array(values, np.int64)
    assert unpacked(*packed(x), len(x)).tolist() == values
