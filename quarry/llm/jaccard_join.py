"""N-gram Jaccard join with a count-vector R-tree.

Every document is the set of its k-word shingles. Tokens (shingles) are
hashed into groups; the counts per group are a point; for two points the sum
of coordinate minima bounds the overlap of the two sets from above, so an
R-tree whose nodes keep coordinate maxima prunes pairs and whole subtrees,
and only survivors are compared shingle by shingle.

A tree prunes what it is asked to compare, but trees of a whole corpus would
be compared by every pair of their tasks, so the corpus is first split into
small blocks between which no link is possible, by the same groups: two sets
that link differ in at most d elements, so of G > d groups at least G - d hold
the same elements in both. The contents of a group are a key. A key that few
documents hold gives the pairs of them, at most FEW * (FEW - 1) / 2; one that
more hold is hot, and gives each of them a count. A document with e empty
groups and h hot keys agrees with any that it links with in G - d - e - h keys
that aren't hot, at least. So pairs that agree in fewer go, and only documents
of which that bound leaves nothing (many copies, or boilerplate alone) meet by
their hot keys, each a star around its key. Chance agreements,
such as a passage that unrelated documents share, don't reach the bound.

Connected components of what is left are the blocks, by bands of size. Trees
over the points of each block leave the pairs that may link; components of
these are the smaller blocks whose shingles are fetched and compared. A block
too large for a task is cut into parts and its pairs of parts are compared in
separate tasks, so copies are never expanded into rows of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, GOLD, U64, batches, cut, drop_cut, fresh, mix, near, packed, slots, small_batches, text_bytes, unpacked, word_hashes
from quarry.llm.components import connected_components, least_reachable

#: Least dimensions of a point, and shingles for each dimension of a longer document's: with few in a group, the minima of unrelated sets add up to little.
DIMS, PER_DIM = 64, 4
#: Documents that a key gives pairs of, at most; share of the largest difference by which groups exceed it, so that hot keys may be left out.
FEW, SPARE = 8, 0.15
#: Bytes of text whose keys meet in one task, the least number of such parts, and bytes of a key beside its part.
PART_TEXT, PARTS, KEY = 1 << 25, 12, 6
#: Documents of a part of a block whose points are compared in one task with as many others.
PART_POINTS = 2048
#: Bytes of points of such a part at most (long documents have long points), and cells of points that are looked at in one go.
PART_BYTES, CELLS = 1 << 22, 1 << 20
LEAF, FANOUT = 16, 8
#: More keys than a set can share.
NEVER = 1 << 40


@dataclass(frozen=True)
class Threshold:
    """k-word shingles; sets link when den * |intersection| >= num * |union|."""

    words: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, total):
        """Least intersection of two sets whose sizes add up to total."""
        return -(-self.num * total // (self.num + self.den))

    def bands(self, upto: int) -> list[tuple[int, int, int, int]]:
        """Bands of sizes that cover 1..upto: (first size, end, groups, empty groups that make a set sparse).

        Sizes that link lie in one band or in two that follow each other.
        Groups exceed the largest difference of two sets of the band that
        link, with a margin for hot keys and groups that stay empty by chance.
        """
        ratio, out, low = max(1.25, self.den / self.num), [], 1
        while low <= upto:
            high = max(low + 1, math.ceil(low * ratio))
            differ = 2 * (high - 1) * (self.den - self.num) // (self.den + self.num)
            groups = 0
            if differ:
                full = differ + 1 + math.ceil(SPARE * differ)
                empty = full * math.exp(-low / full)
                groups = full + math.ceil(empty + 4 * math.sqrt(empty))
            out.append((low, high, groups, groups - differ))
            low = high
        return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row with 1..k-1 words has one, one without words none."""
    words, rows = word_hashes(data, offsets)
    at = slots(rows, len(offsets) - 1)
    out = []
    with np.errstate(over="ignore"):
        weights = mix(np.arange(1, k + 1, dtype=U64) * GOLD) | U64(1)
        n = max(0, len(words) - k + 1)
        joined = np.zeros(n, U64)
        for j in range(k):
            joined += words[j : j + n] * weights[j]
        joined = mix(joined)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(joined[a : b - k + 1]))
            elif b > a:
                short = (words[a:b] * weights[: b - a]).sum(dtype=U64) + U64(b - a) * GOLD
                out.append(mix(np.array([short], U64)))
            else:
                out.append(np.empty(0, U64))
    return out


def dims(n: int) -> int:
    """Dimensions of the point of a set of n shingles: a power of two, so that a longer point folds into a shorter one."""
    return max(DIMS, 1 << max(0, (n // PER_DIM - 1).bit_length()))


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the shingles by group, in bytes or, if one is above 255, in two bytes each; groups are the first bits of the hash."""
    bits = dims(len(s)).bit_length() - 1
    counts = np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint16)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points of one dimension, the least of theirs: neighbouring groups add up."""
    least = min(len(p) for p in points)
    out = np.stack([p.reshape(least, -1).sum(1) for p in points])
    return out.astype(np.uint8 if out.max() < 256 else np.int32)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles, as two signed 64-bit integers."""
    with np.errstate(over="ignore"):
        both = np.array([mix(s ^ GOLD).sum(dtype=U64), mix(s * GOLD + U64(1)).sum(dtype=U64)], U64).view(np.int64)
    return int(both[0]), int(both[1])


def band_keys(s: np.ndarray, t: Threshold, bands: list) -> tuple[np.ndarray, int]:
    """Keys of the contents of each group that isn't empty, in the set's own band and the one above if it reaches it, and what agrees at least.

    The second value is the least number of these keys that a set which links
    shares; if a band leaves none, its sets have a key in common instead.
    """
    n, out, agree = len(s), [], NEVER
    with np.errstate(over="ignore"):
        for i, (low, high, groups, sparse) in enumerate(bands):
            if not (low <= n < high or (n < low and n * t.den >= low * t.num)) or not groups:
                continue
            group = ((s >> U64(32)) * U64(groups)) >> U64(32)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            content = np.add.reduceat(mix(s ^ U64(0xA5A5A5A5)), first)
            salt = U64(i + 1) * GOLD
            out.append(mix(content + mix(group[first] * GOLD + salt)))
            shared = sparse - (groups - len(first))
            agree = min(agree, shared)
            if shared <= 0:
                out.append(mix(np.array([salt], U64)))
    return (np.concatenate(out) if out else np.empty(0, U64)), agree


def _met_in(keys: np.ndarray, nodes: np.ndarray, few: int = FEW) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What the holders (keys, nodes) of one part of the keys give.

    (a, b, keys that both hold) of pairs by keys of 2 to `few` nodes, (node,
    hot keys it holds) and the ascending nodes of each hot key, once for keys
    of the same nodes. A node that holds a key twice counts once.
    """
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    if len(keys):
        own = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[own], nodes[own]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    held = np.diff(np.append(first, len(keys)))
    pairs = [np.empty((0, 2), np.int64)]
    for size in range(2, few + 1):
        group = nodes[first[held == size][:, None] + np.arange(size)]
        pairs += [group[:, [i, j]] for i in range(size) for j in range(i + 1, size)]
    ab = np.concatenate(pairs)
    ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
    at = np.flatnonzero(np.concatenate([[True], (ab[1:] != ab[:-1]).any(1)])) if len(ab) else np.empty(0, np.int64)
    counted = np.column_stack([ab[at], np.diff(np.append(at, len(ab)))])
    hot = held > few
    warm = np.column_stack(np.unique(nodes[np.repeat(hot, held)], return_counts=True))
    groups = {nodes[x : x + y].tobytes() for x, y in zip(first[hot], held[hot], strict=True)}
    return counted, warm, [np.frombuffer(x, np.int64) for x in sorted(groups)]


_MAPPED = "pid int, kind int, base long, keys binary, nodes binary, agree binary, n binary, f1 binary, f2 binary"
_TABLE = "kind int, a long, b long, n long, f1 long, f2 long, point binary, held array<long>"


def _map(it: Iterator[pa.RecordBatch], t: Threshold, pids: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) and, by part, keys with the documents that hold them (kind 1).

    Copies within the task are known by fingerprint and give keys once. A key
    takes KEY bytes, as its part stands for the first ones, and its node as
    few bytes as the nodes of a row need. base holds for documents nothing, n
    is twice the size of the set, one more if its point has two bytes a group.
    """
    schema = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("base", pa.int64()), *((c, pa.binary()) for c in ("keys", "nodes", "agree", "n", "f1", "f2"))])

    def row(pid: int, kind: int, base: int = 0, **columns: np.ndarray | bytes) -> dict:
        return {"pid": pid, "kind": kind, "base": base} | {c: x.tobytes() if isinstance(x := columns.get(c), np.ndarray) else x for c in schema.names[3:]}

    def keyed(pid: int, keys: np.ndarray, nodes: np.ndarray) -> dict:
        base, near_base = packed(nodes)
        return row(pid, 1, base, keys=keys.view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes(), nodes=near_base)

    bands, seen, held, size = t.bands(1 << 12), set(), [], 0

    def flush() -> list[dict]:
        keys, nodes = (np.concatenate([x[j] for x in held]) for j in (0, 1))
        held.clear()
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        pid = ((keys >> U64(32)) * U64(pids)) >> U64(32)
        at = np.searchsorted(pid, np.arange(pids + 1, dtype=U64))
        return [keyed(p, keys[a:b], nodes[a:b]) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]

    for whole in it:
        for batch in batches(whole, "text", 1 << 21):
            ids = batch.column("doc_id")
            sets = shingle_sets(*text_bytes(batch.column("text")), t.words)
            known, agree, n = [], [], [len(s) for s in sets]
            points = [point(s) for s in sets]
            while max(n, default=0) >= bands[-1][0]:
                bands = t.bands(2 * bands[-1][1])
            for node, s in zip(ids.to_pylist(), sets, strict=True):
                f = fingerprint(s)
                known.append(f)
                agree.append(NEVER)
                if node is None or not len(s) or (f, len(s)) in seen:
                    continue
                seen.add((f, len(s)))
                keys, agree[-1] = band_keys(s, t, bands)
                if len(keys):
                    held.append((keys, np.full(len(keys), node, np.int64)))
                    size += len(keys)
            f1, f2 = (np.array([f[j] for f in known], np.int64) for j in (0, 1))
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            if there.any():
                nodes = np.array([x for x in ids.to_pylist() if x is not None], np.int64)
                part = int(mix(nodes.view(U64)).min() % U64(pids))  # by ids, not texts, as a text may be in any number of rows
                out = [row(part, 0, nodes=nodes, agree=np.array(agree, np.int64)[there], n=np.array([2 * x + (p.itemsize > 1) for x, p in zip(n, points, strict=True)], np.int64)[there], f1=f1[there], f2=f2[there], keys=b"".join(p.tobytes() for p, ok in zip(points, there, strict=True) if ok))]
                yield pa.RecordBatch.from_pylist(out, schema)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_pylist(flush(), schema)
                size = 0
    if held:
        yield pa.RecordBatch.from_pylist(flush(), schema)


def _reduce(table: pa.Table) -> pa.Table:
    """The documents of one part (kind 0: id, keys shared at least, size, fingerprint, point) and what its keys give.

    Pairs (kind 1: a, b, n keys), documents with hot keys (kind 2: a, n of
    them) and the documents of each hot key (kind 3: held).
    """
    ints = lambda x: np.frombuffer(x, np.int64)
    keys, nodes, docs = [np.empty(0, U64)], [np.empty(0, np.int64)], []
    for x in table.to_batches():
        for kind, base, key, node, *rest in zip(*(x.column(c).to_pylist() for c in ("kind", "base", "keys", "nodes", "agree", "n", "f1", "f2")), strict=True):
            if kind == 0:
                docs.append((ints(node), *map(ints, rest), key))
                continue
            n = len(key) // KEY
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :KEY] = np.frombuffer(key, np.uint8).reshape(n, KEY)
            keys.append(wide.view(U64).ravel())
            nodes.append(unpacked(base, node, n))
    names = ("kind", "a", "b", "n", "f1", "f2")
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in names[1:]), ("point", pa.binary()), ("held", pa.list_(pa.int64()))])

    def rows(kind: int, count: int, **columns) -> pa.Table:
        return pa.table([pa.array(np.full(count, kind, np.int32)), *((x if isinstance(x := columns[c], pa.Array) else pa.array(x)) if c in columns else pa.nulls(count, schema.field(c).type) for c in schema.names[1:])], schema)

    out = []
    for node, agree, n, f1, f2, points in docs:
        at = np.concatenate([[0], np.cumsum([dims(int(x >> 1)) << int(x & 1) for x in n])])
        out.append(rows(0, len(node), a=node, b=agree, n=n >> 1, f1=f1, f2=f2, point=pa.array([points[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())))
    pairs, warm, hot = _met_in(np.concatenate(keys), np.concatenate(nodes))
    out.append(rows(1, len(pairs), a=pairs[:, 0].copy(), b=pairs[:, 1].copy(), n=pairs[:, 2].copy()))
    out.append(rows(2, len(warm), a=warm[:, 0].copy(), n=warm[:, 1].copy()))
    out.append(rows(3, len(hot), held=pa.array(hot, pa.list_(pa.int64()))))
    return pa.concat_tables(out)


class CountTree:
    """An R-tree over count vectors, packed bottom-up in order of size; nodes keep coordinate maxima and extreme sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        points, sizes = points[self.order], sizes[self.order]
        self.levels = [(points, sizes, sizes)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            high, least, most = self.levels[-1]
            first = np.arange(0, len(least), width)
            self.levels.append((np.maximum.reduceat(high, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))
            width = FANOUT

    def pairs(self, other: CountTree, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
        """Positions (i in self, j in other) whose bound doesn't rule out a link; i < j in tree order if other is self."""
        same = other is self
        depth = max(len(self.levels), len(other.levels))
        left, right = (x.levels + [x.levels[-1]] * (depth - len(x.levels)) for x in (self, other))
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        step = max(1, CELLS // self.levels[0][0].shape[1])
        for level in range(depth - 1, -1, -1):
            (high_a, least_a, most_a), (high_b, least_b, most_b) = left[level], right[level]
            keep = []
            for i in range(0, len(a), step):
                x, y = a[i : i + step], b[i : i + step]
                near = (most_a[x] * t.den >= least_b[y] * t.num) & (most_b[y] * t.den >= least_a[x] * t.num)
                x, y = x[near], y[near]
                bound = np.minimum(high_a[x], high_b[y]).sum(1, dtype=np.int64)
                ok = bound >= t.overlap(least_a[x] + least_b[y])
                keep.append((x[ok], y[ok]))
            a, b = (np.concatenate([k[j] for k in keep] or [a[:0]]) for j in (0, 1))
            if level and len(a):
                width = LEAF if level == 1 else FANOUT
                a, b = self._children(a, b, (len(left[level - 1][1]), len(right[level - 1][1])), (width if left[level] is not left[level - 1] else 1, width if right[level] is not right[level - 1] else 1))
                if same:
                    a, b = a[a <= b], b[a <= b]
        if same:
            a, b = a[a < b], b[a < b]
        return self.order[a], other.order[b]

    @staticmethod
    def _children(a, b, counts, widths):
        x = (a[:, None] * widths[0] + np.arange(widths[0])).repeat(widths[1], axis=1).ravel()
        y = np.tile(b[:, None] * widths[1] + np.arange(widths[1]), (1, widths[0])).ravel()
        ok = (x < counts[0]) & (y < counts[1])
        return x[ok], y[ok]


def verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
    """Which of the pairs (left[i], right[j]) link, by their exact intersections."""
    if not len(i):
        return np.empty(0, bool)
    everything = np.unique(np.concatenate([*left, *right]))
    mark = np.zeros(len(everything), bool)
    code = [np.searchsorted(everything, s) for s in right]
    ok = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) != 0, [True]]))
    for a, b in zip(at[:-1], at[1:], strict=True):
        mine = np.searchsorted(everything, left[i[order[a]]])
        mark[mine] = True
        for lo in range(a, b, 512):
            rows = order[lo : min(lo + 512, b)]
            theirs = [code[x] for x in j[rows]]
            sizes = np.array([len(x) for x in theirs])
            shared = np.add.reduceat(mark[np.concatenate(theirs)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            ok[rows] = shared >= t.overlap(len(mine) + sizes)
        mark[mine] = False
    return ok


def _survivors(points: list[np.ndarray], sizes: np.ndarray, split: int | None, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that the count tree can't rule out: of all, or between those before `split` and the others."""
    none = np.empty(0, np.int64)
    if split is not None and not 0 < split < len(points):
        return none, none
    flat = folded(points)
    if split is None:
        tree = CountTree(flat, sizes)
        return tree.pairs(tree, t)
    i, j = CountTree(flat[:split], sizes[:split]).pairs(CountTree(flat[split:], sizes[split:]), t)
    return i, j + split


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, int | None]]:
    """Rows of each block that came to one task, by part and document, and where part 2 begins if the block is two parts' meeting."""
    block, part, rep = (table.column(c).to_numpy() for c in ("block", "part", "rep"))
    order = np.lexsort((rep, part, block))
    at = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]]))
    for x, y in zip(at[:-1], at[1:], strict=True):
        rows = order[x:y]
        yield rows, None if part[rows[0]] == 0 else int(np.searchsorted(part[rows], 2))


def _sift(table: pa.Table, t: Threshold) -> pa.Table:
    """Edges between documents whose points allow a link, each to the least that it reaches within the block.

    A block holds the sets of one band of sizes and those of the band below
    that reach it; two of the latter meet in their own band.
    """
    nodes, n, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "own"))
    points = [np.frombuffer(x, np.uint8 if len(x) == dims(int(k)) else np.uint16) for x, k in zip(table.column("point").to_pylist(), n, strict=True)]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for rows, split in _blocks(table):
        i, j = _survivors([points[r] for r in rows], n[rows], split, t)
        real = own[rows][i] | own[rows][j]
        root = least_reachable(nodes[rows], i[real], j[real])
        a.append(nodes[rows][nodes[rows] != root])
        b.append(root[nodes[rows] != root])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _verify(table: pa.Table, t: Threshold) -> pa.Table:
    """Links within the blocks (part 0), or between two parts of a block (1 and 2), that came to one task: (doc, links, root).

    A document that came more than once with the same shingles counts once.
    """
    nodes, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    out_node, out_links, out_root = [], [], []
    part = table.column("part").to_numpy()
    for rows, split in _blocks(table):
        rows = rows[[k == 0 or nodes[r] != nodes[rows[k - 1]] or len(sets[r]) != len(sets[rows[k - 1]]) or (sets[r] != sets[rows[k - 1]]).any() for k, r in enumerate(rows)]]
        split = None if split is None else int(np.searchsorted(part[rows], 2))
        own, mine = nodes[rows], [sets[r] for r in rows]
        i, j = _survivors([point(x) for x in mine], np.array([len(x) for x in mine], np.int64), split, t)
        ok = verified(mine, mine, i, j, t)
        i, j = i[ok], j[ok]
        weight = copies[rows]
        links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        out_node.append(own)
        out_links.append(links.astype(np.int64))
        out_root.append(least_reachable(own, i, j))
    return pa.table({"doc": np.concatenate(out_node), "links": np.concatenate(out_links), "root": np.concatenate(out_root)})


def _met(rows: DataFrame, bins: int, *columns: str) -> DataFrame:
    """(task, block, part, rep, columns): rows (comp, parts, rep) dealt to the tasks that compare them.

    Blocks of one part are gathered in `bins` tasks. Of a larger block each
    part meets itself (part 0) and each other part (1 and 2) in its own task.
    """
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int")
    every = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    pair = F.xxhash64("comp", F.least("mine", "with"), F.greatest("mine", "with"))
    alone = F.col("parts") == 1
    return rows.withColumn("mine", mine).withColumn("with", F.explode(every)).select(
        F.when(alone, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(pair).alias("task"), F.when(alone, F.col("comp")).otherwise(pair).alias("block"),
        F.when(alone | (F.col("mine") == F.col("with")), 0).when(F.col("mine") < F.col("with"), 1).otherwise(2).alias("part"), "rep", *columns,
    )


def _sets(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Texts replaced by their shingles; rows whose shingles are not those of the class they stand for go."""
    for whole in it:
        for batch in batches(whole, "text", 1 << 21):
            sets = shingle_sets(*text_bytes(batch.column("text")), k)
            keep = pa.array([fingerprint(s) == f for s, f in zip(sets, zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), strict=True), strict=True)], pa.bool_())
            columns = {c: batch.column(c) for c in ("rep", "comp", "copies", "parts")} | {"shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns).filter(keep)


def _agreeing(table: DataFrame, few: Callable[..., DataFrame]) -> DataFrame:
    """Edges (a, b) between documents that share as many keys as a link of theirs would, and from those that may share hot keys alone to these, from what the parts of the keys gave."""
    warm = cut(table.where("kind = 2").groupBy("a").agg(F.sum("n").alias("hot")))
    least = table.where("kind = 0").groupBy("a").agg(F.min("b").alias("agree")).where(F.col("agree") < NEVER)
    bound = cut(least.join(few(warm), "a", "left").select("a", (F.col("agree") - F.coalesce("hot", F.lit(0))).alias("bound")))
    pairs = table.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n"))
    of_b = bound.select(F.col("a").alias("b"), F.col("bound").alias("other"))
    kept = pairs.join(few(bound), "a").where("n >= bound").join(few(of_b, bound), "b").where("n >= other").select("a", "b")
    # documents that may share hot keys alone meet at the key, a node of its own; should it be a document's id, blocks only grow
    alone = cut(bound.where("bound <= 0").select(F.col("a").alias("node")))
    meet = table.where("kind = 3").select(F.xxhash64("held").alias("key"), F.explode("held").alias("node")).join(few(alone), "node")
    return kept.unionByName(meet.select(F.col("node").alias("a"), F.col("key").alias("b")))


def jaccard_join(docs: DataFrame, threshold: Threshold | None = None, part_size: int = 1 << 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id long, text string): doc_id, n_shingles, component_id, n_links, copy_of.

    n_shingles is the size of the row's set, component_id the least doc_id
    reachable by links, n_links the number of other documents it links with,
    copy_of the least doc_id with the same set. Other columns of docs are not
    read. part_size bounds the shingles (a document counts as 512 at least)
    that a task compares with as many others; broadcast_rows bounds each table
    of numbers that a join broadcasts, larger ones are shuffled.

    Null and blank texts have no shingles and link with nothing. A null
    doc_id has a null component and takes no part. Rows with one doc_id are
    one document: it has the links of all its rows, and identical rows link
    it to itself no further. An empty table gives an empty one. Links are
    exact but for collisions of 64-bit hashes of shingles and contents.
    """
    t = threshold or Threshold()
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = lambda x, of=None: near(x, broadcast_rows, of)
    components = lambda x: connected_components(x, broadcast_rows=broadcast_rows)
    named = lambda x: x.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    # parts go by the bytes of the texts, so that a part's work is the same at every size
    pids = max(PARTS, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART_TEXT))
    mapped = docs.mapInArrow(lambda it: _map(it, t, pids), _MAPPED)
    table = cut(mapped.repartition(pids, "pid").groupBy("pid").applyInArrow(_reduce, _TABLE))
    rows = table.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "f1", "f2")
    # one row for each document and set, then one for each set that several documents have; blank texts have none
    each = cut(rows.distinct())
    copied = cut(each.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    of_set = each.where("n > 0").join(few(copied), ["f1", "f2", "n"], "left").select("doc_id", "n", "f1", "f2", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    member = cut(of_set.unionByName(each.where("n = 0").select("*", F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("copies"))))
    drop_cut(each, copied)
    copies = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    agreed = components(_agreeing(table, few).unionByName(copies))
    reps = member.where("doc_id = rep").select("rep", "n", "f1", "f2", "copies")
    tagged = cut(reps.join(few(named(agreed), agreed), "rep"))
    crowd = cut(tagged.groupBy("comp").count().where("count > 1").select("comp"))
    several = tagged.join(few(crowd), "comp")
    points = table.where("kind = 0").select(F.col("a").alias("rep"), "f1", "f2", "point")
    pointed = cut(points.join(few(several, tagged), ["rep", "f1", "f2"]).dropDuplicates(["rep", "f1", "f2"]).select("rep", "n", "point", "comp"))
    longest = member.agg(F.max("n")).first()[0] or 1
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high, *_) in enumerate(t.bands(longest))))
    size = F.col("n")
    mine_or_next = F.filter(bands, lambda b: ((b["low"] <= size) & (size < b["high"])) | ((size < b["low"]) & (size * t.den >= b["low"] * t.num)))
    banded = pointed.select("rep", "n", "point", "comp", F.explode(mine_or_next).alias("b")).select("rep", "n", "point", F.xxhash64("comp", "b.band").alias("comp"), (F.col("b.low") <= F.col("n")).alias("own"))
    met = cut(banded.groupBy("comp").agg(F.count("*").alias("sets"), F.sum(F.length("point")).alias("bytes")).where("sets > 1").withColumn("parts", F.greatest(F.ceil(F.col("sets") / PART_POINTS), F.ceil(F.col("bytes") / PART_BYTES)).cast("int")))
    n_small, n_bytes = met.where("parts = 1").agg(F.sum("sets"), F.sum("bytes")).first()
    bins = max(1, math.ceil((n_small or 0) / PART_POINTS), math.ceil((n_bytes or 0) / PART_BYTES))
    sifted = cut(_met(banded.join(few(met.select("comp", "parts"), met), "comp"), bins, "n", "point", "own").groupBy("task").applyInArrow(lambda x: _sift(x, t), "a long, b long"))
    drop_cut(tagged, pointed, met)
    weight = F.greatest("n", F.lit(512))
    alike = components(sifted)
    placed = cut(reps.join(few(named(alike), alike), "rep").withColumn("weight", weight))
    held = placed.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("weight").alias("all")).where("sets > 1").select("comp", F.ceil(F.col("all") / part_size).cast("int").alias("parts"))
    todo = cut(placed.join(few(cut(held)), "comp").select("rep", "comp", "f1", "f2", "copies", "parts", "weight"))
    small = todo.where("parts = 1").agg(F.sum("weight")).first()[0]
    bins = max(1, math.ceil((small or 0) / part_size))
    found = docs.join(few(todo), F.col("doc_id") == F.col("rep")).select("rep", "comp", "f1", "f2", "copies", "parts", "text")
    k = t.words
    shingles = found.mapInArrow(lambda it: _sets(it, k), "rep long, comp long, copies long, parts int, shingles binary")
    spread = _met(shingles, bins, "copies", "shingles")
    links = cut(spread.groupBy("task").applyInArrow(lambda x: _verify(x, t), "doc long, links long, root long"))
    drop_cut(sifted, placed)
    joined = components(links.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    linked = cut(links.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links")).join(few(named(joined), joined), "rep", "left"))
    known = member.join(few(linked), "rep", "left").select("doc_id", "rep", F.coalesce("comp", "rep").alias("of"), F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("links"))
    by_doc = known.groupBy("doc_id").agg(F.min("of").alias("component_id"), F.sum("links").alias("n_links"), F.min("rep").alias("copy_of"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(by_doc, "doc_id")
    nameless = docs.where("doc_id IS NULL").mapInArrow(lambda it: _nameless(it, k), "n_shingles long")
    none = F.lit(None).cast("long")
    return out.unionByName(nameless.select(none.alias("doc_id"), "n_shingles", none.alias("component_id"), F.lit(0).cast("long").alias("n_links"), none.alias("copy_of")))


def _nameless(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield pa.RecordBatch.from_pydict({"n_shingles": pa.array([len(s) for s in shingle_sets(*text_bytes(batch.column("text")), k)], pa.int64())})


def one_of_each(docs: DataFrame, threshold: Threshold | None = None, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs that stand for their group: of each component of links the row with the least doc_id.

    Rows without words link with nothing and stay, as do rows with a null
    doc_id. Rows repeated with the kept doc_id stay once. All columns of docs
    are kept, whatever their names; an empty table gives an empty one. The ids
    that go are broadcast up to broadcast_rows of them, so that texts aren't
    shuffled; a larger table is joined by shuffle.
    """
    (named,) = fresh(docs, "_id")
    found = cut(jaccard_join(docs, threshold).where("doc_id IS NOT NULL").select("doc_id", "component_id"))
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(named)).distinct())
    twice = cut(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(named)).count().where("count > 1").select(named))
    same = F.col("doc_id").cast("long") == F.col(named)
    kept = docs.join(near(gone, broadcast_rows), same, "left_anti")
    if twice.isEmpty():
        return kept
    ids = near(twice, broadcast_rows)
    return kept.join(ids, same, "left_anti").unionByName(kept.join(ids, same, "left_semi").dropDuplicates(["doc_id"]))
