"""Approximate nearest neighbours by cosine: a navigable small-world graph for each shard, in flat arrays."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.vectors import distinct_rows, search, usable


class Graph:
    """Layers of a hierarchical small-world graph over unit vectors.

    Level l holds about 1/m^l of the points (drawn by a hash of the id, so
    rebuilding gives the same graph). A layer's neighbours are a flat array of
    shape (points, degree) padded with -1. A point's links are picked from its
    nearest points in the layer, skipping one that is nearer to a link picked
    before than to the point itself, then filled up with the nearest, and made
    mutual while the degree allows.
    """

    def __init__(self, unit: np.ndarray, ids: np.ndarray, m: int = 16):
        self.unit = unit.astype(np.float32)
        n = len(unit)
        with np.errstate(over="ignore"):
            h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        level = np.floor(-np.log(((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53) / np.log(m)).astype(int)
        self.layers = []
        for at in range(int(level.max()) + 1 if n else 0):
            nodes = np.flatnonzero(level >= at)
            self.layers.append((nodes, self._links(nodes, 2 * m if at == 0 else m)))
        self.entry = int(np.argmax(level)) if n else -1

    def _links(self, nodes: np.ndarray, degree: int) -> np.ndarray:
        x, n = self.unit[nodes], len(nodes)
        near = min(n - 1, 2 * degree)
        links = np.full((n, degree), -1, np.int32)
        if near <= 0:
            return links
        chosen: list[list[int]] = [[] for _ in range(n)]
        for start in range(0, n, 512):
            sims = x[start : start + 512] @ x.T
            sims[np.arange(len(sims)), np.arange(start, start + len(sims))] = -np.inf
            top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
            between = np.einsum("nid,njd->nij", x[top], x[top])
            own = np.take_along_axis(sims, top, 1)
            picked = np.zeros(top.shape, bool)
            for j in range(near):
                hidden = (picked & (between[:, j] > own[:, j : j + 1])).any(1)
                picked[:, j] = ~hidden & (picked.sum(1) < degree // 2)
            order = np.argsort(~picked, axis=1, kind="stable")
            for r, row in enumerate(np.take_along_axis(top, order, 1)[:, :degree]):
                chosen[start + r] = [int(c) for c in row[: 3 * degree // 4]]
        for a in range(n):
            for b in chosen[a][: degree // 2]:
                if len(chosen[b]) < degree and a not in chosen[b]:
                    chosen[b].append(a)
        for a, row in enumerate(chosen):
            links[a, : len(row)] = nodes[row]
        return links

    def nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Positions (queries, ef) of the points found nearest, -1 where there are fewer; all queries walk at once."""
        n, count = len(self.unit), len(q)
        q = q.astype(np.float32)
        now = np.full(count, self.entry, np.int64)
        best = self.unit[now[0]] @ q.T if count else np.empty(0, np.float32)
        for nodes, links in reversed(self.layers[1:]):
            where = np.full(n, -1, np.int64)
            where[nodes] = np.arange(len(nodes))
            while True:
                near = links[where[now]]
                sims = np.einsum("nkd,nd->nk", self.unit[near], q)
                sims[near < 0] = -np.inf
                to = sims.argmax(1)
                better = sims[np.arange(count), to] > best
                if not better.any():
                    break
                now = np.where(better, near[np.arange(count), to], now)
                best = np.maximum(best, sims[np.arange(count), to])
        links = self.layers[0][1]
        ef = min(ef, n)
        seen = np.zeros((count, n), bool)
        seen[np.arange(count), now] = True
        found, score = np.full((count, ef), -1, np.int64), np.full((count, ef), -np.inf, np.float32)
        open_ = np.zeros((count, ef), bool)
        found[:, 0], score[:, 0], open_[:, 0] = now, best, True
        active = np.arange(count)
        while len(active):
            at = np.where(open_[active], score[active], -np.inf).argmax(1)
            go = open_[active, at]
            active, at = active[go], at[go]
            if not len(active):
                break
            open_[active, at] = False
            near = links[found[active, at]].astype(np.int64)
            rows = np.repeat(active, near.shape[1]).reshape(near.shape)
            fresh = (near >= 0) & ~seen[rows, near]
            seen[rows[fresh], near[fresh]] = True
            sims = np.einsum("nkd,nd->nk", self.unit[near], q[active])
            sims[~fresh] = -np.inf
            all_score = np.concatenate([score[active], sims], 1)
            top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef] if all_score.shape[1] > ef else np.tile(np.arange(ef), (len(active), 1))
            score[active] = np.take_along_axis(all_score, top, 1)
            found[active] = np.take_along_axis(np.concatenate([found[active], near], 1), top, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], 1), top, 1) & np.isfinite(score[active])
        found[~np.isfinite(score)] = -1
        return found


def _build(ids: np.ndarray, x: np.ndarray, keep: int, m: int) -> bytes:
    x, ids, at = distinct_rows(ids, x, keep)
    with np.errstate(over="ignore"):
        unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = Graph(unit, ids[at[:-1]], m)
    return pickle.dumps((x, ids, at, graph.unit, graph.layers, graph.entry))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of a and b in double precision, safe from overflow and underflow by prior scaling."""
    a = a / np.abs(a).max(1, keepdims=True)
    b = b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _answer(index: tuple, own: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, ids, at, unit, layers, entry = index
    graph = Graph.__new__(Graph)
    graph.unit, graph.layers, graph.entry = unit, layers, entry
    scaled = q / np.abs(q).max(1, keepdims=True)
    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
    rows, found, value = [], [], []
    for start in range(0, len(q), 256):
        near = graph.nearest(scaled[start : start + 256], ef)
        r, c = np.nonzero(near >= 0)
        p = near[r, c]
        exact = cosine(q[start + r], x[p])
        sizes = at[p + 1] - at[p]
        r, p, exact = np.repeat(start + r, sizes), np.repeat(p, sizes), np.repeat(exact, sizes)
        first = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        vec = ids[at[p] + np.arange(len(p)) - first]
        other = vec != own[r]
        r, vec, exact = r[other], vec[other], exact[other]
        order = np.lexsort((vec, -exact, r))
        r, vec, exact = r[order], vec[order], exact[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[rank < k])
        found.append(vec[rank < k])
        value.append(exact[rank < k])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(value)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_size: int = 4096, m: int = 16, ef: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors found nearest to each row of queries, itself left out.

    vectors and queries: vec_id long, embedding array of numbers; other
    columns are not read. The score is the cosine of the original vectors in
    double precision, ties go to the smaller vec_id. Every usable row is in
    the index: null and zero vectors and vectors with a null or non-finite
    component take no part on either side, nor do rows with a null vec_id. The
    score scales both vectors before it multiplies, so that nothing overflows;
    its last bits may differ from those of the plain formula.
    Vectors of different dimension never meet. Equal vectors share one node
    of the graph. Fewer than k candidates give fewer rows, an empty table none.
    """
    live = lambda x: usable(x).where(F.exists("v", lambda c: c != 0))
    return search(live(vectors), live(queries), lambda i, x: _build(i, x, k + 1, m), lambda x, i, q: _answer(x, i, q, k, ef), k, shard_size, "double")
