"""Language-model scores by prediction by partial matching over bytes, beside a unigram base.

A text is its UTF-8 bytes with A-Z lower-cased and an end symbol. The trie of
contexts of up to ORDER bytes is pretrained on the training rows: a task
counts its grams (context and symbol packed into one integer), tasks' counts
meet by the two bytes before the symbol, and as every longer context of a gram
ends in these, each part of the trie then works out alone the probability of
each gram that occurs in the corpus: count over total plus distinct symbols
where the symbol was seen in a context, else the escape to the next shorter
context, from which the symbols of the longer one are excluded. A document's
score is the sum over its grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _LOWER, GOLD, U64, batches, crc_mod, cut, mix, packed, partitions, slots, small_batches, text_bytes, unpacked, word_hashes

ORDER = 5
#: Bytes that UTF-8 never holds: before a text and after it.
PAD, END = 0xFE, 0xFF
#: Symbols there are: the other 254 bytes and the end.
ALPHABET = 255
#: The end token of the unigram base; words are hashed to other values but for one chance in 2^64.
END_TOKEN = U64(0x656E64)
#: Occurrences of a part of the tables that meet its part in one task, where the tables are too large to be broadcast.
MEETING = 4_000_000


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol of each row with the `order` bytes before it, packed low byte last, and n + 1 offsets by row."""
    lengths = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(lengths + order + 1)])
    text = np.full(at[-1], PAD, np.uint8)
    shift = np.repeat(at[:-1] + order - offsets[:-1], lengths)
    text[np.arange(len(data)) + shift] = _LOWER[data]
    text[at[1:] - 1] = END
    code = text.astype(U64)
    for j in range(1, order + 1):
        code[j:] |= text[:-j].astype(U64) << U64(8 * j)
    real = np.ones(at[-1], bool)
    real[(at[:-1, None] + np.arange(order)).ravel()] = False
    return code[real], np.concatenate([[0], np.cumsum(lengths + 1)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and its end token, and n + 1 offsets by row."""
    words, rows = word_hashes(data, offsets)
    at = slots(rows, len(offsets) - 1)
    return np.insert(words, at[1:], END_TOKEN), at + np.arange(len(at))


class Tally:
    """Counts of integers, merged now and then so that memory follows the distinct ones."""

    def __init__(self):
        self.keys, self.counts, self.held, self.size = np.empty(0, U64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable") if len(keys) < 2 else None
        if order is None:
            both = np.sort((keys << U64(1)) | train.astype(U64)) if keys.max() < U64(1 << 62) else None
            if both is not None:
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                n = np.diff(np.append(first, len(both)))
                keys, counts = both[first] >> U64(1), np.where(both[first] & U64(1), n, 0)
            else:
                order = np.argsort(keys, kind="stable")
        if order is not None:
            keys, counts = keys[order], train[order].astype(np.int64)
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > max(1 << 20, 2 * len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.held)])
        counts = np.concatenate([self.counts, *(c for _, c in self.held)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.held, self.size = [], 0
        return self.keys, self.counts


_BLOBS = "kind int, pid int, keys binary, counts binary"


def _blob(kind: int, pid: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "pid": pa.array([pid], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _part(kind: int, keys: np.ndarray, pids: int) -> np.ndarray:
    """The part of the tables that knows each key: of grams by the two bytes before the symbol."""
    with np.errstate(over="ignore"):
        return (mix((keys >> U64(8) & U64(0xFFFF)) * GOLD if kind == 0 else keys) % U64(pids)).astype(np.int64)


def _count(it: Iterator[pa.RecordBatch], pids: int) -> Iterator[pa.RecordBatch]:
    """What a task has seen: kind 0 grams with their training counts, kind 1 training tokens, by the part they go to."""
    seen = Tally(), Tally()
    for whole in it:
        for batch in batches(whole, "text", 1 << 19):
            data, offsets = text_bytes(batch.column("text"))
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            keys, at = grams(data, offsets)
            seen[0].add(keys, np.repeat(train, np.diff(at)))
            keys, at = tokens(data, offsets)
            keys = keys[np.repeat(train, np.diff(at))]
            seen[1].add(keys, np.ones(len(keys), bool)) if len(keys) else None
    for kind, tally in enumerate(seen):
        keys, counts = tally.merge()
        part = _part(kind, keys, pids)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(pids + 1))
        for pid, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a:
                yield _blob(kind, pid, keys[order[a:b]], counts[order[a:b]])


def _merge(table: pa.Table) -> pa.Table:
    tally = Tally()
    for keys, counts in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
        tally.held.append((np.frombuffer(keys, U64), np.frombuffer(counts, np.int64)))
    kind, pid = (table.column(c)[0].as_py() for c in ("kind", "pid"))
    return pa.Table.from_batches([_blob(kind, pid, *tally.merge())])


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the trie: counts of each symbol after one byte. Of the tokens: how many there are and how many distinct."""
    for batch in it:
        for kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
            keys, counts = np.frombuffer(keys, U64), np.frombuffer(counts, np.int64)
            if kind == 0:
                n = np.bincount((keys & U64(0xFFFF)).astype(np.int64), counts, 1 << 16).astype(np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"what": at, "n": n[at]})
            else:
                yield pa.RecordBatch.from_pydict({"what": np.array([-1, -2]), "n": np.array([counts.sum(), len(keys)])})


def _find(keys: np.ndarray, values: list[np.ndarray], wanted: np.ndarray) -> list[np.ndarray]:
    """The values at the wanted keys of an ascending array, 0 where a key isn't there."""
    if not len(keys):
        return [np.zeros(len(wanted), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return [np.where(hit, v[at], 0) for v in values]


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of each gram of a part of the trie; counts are those in training, low[a, s] of s after byte a.

    keys: the ascending grams of some pairs of bytes before the symbol, all of them.
    """
    masks = [U64((1 << 8 * (k + 1)) - 1) for k in range(order + 1)]
    trie = {1: (np.flatnonzero(low).astype(U64), low.ravel()[low.ravel() > 0])}
    trie[0] = (np.flatnonzero(low.sum(0)).astype(U64), low.sum(0)[low.sum(0) > 0])
    for k in range(order, 1, -1):
        g, c = keys & masks[k], counts
        by = np.argsort(g, kind="stable")
        g, c = g[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        g, c = g[first], np.add.reduceat(c, first) if len(first) else c
        trie[k] = (g[c > 0], c[c > 0])
    context = {}
    for k, (g, c) in trie.items():
        h = g >> U64(8)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        shorter = _find(*(trie[k - 1][0], [trie[k - 1][1]]), g & masks[k - 1])[0] if k else np.zeros(len(g), np.int64)
        add = lambda x, first=first: np.add.reduceat(x, first) if len(first) else x[:0]
        context[k] = (h[first], [add(c), add(np.ones(len(c), np.int64)), add(shorter)])
    out = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    hidden, hidden_n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for k in range(order, -1, -1):
        c = _find(trie[k][0], [trie[k][1]], keys & masks[k])[0]
        total, kinds, below = _find(*context[k], (keys & masks[k]) >> U64(8))
        n, t = total - hidden_n, kinds - hidden
        here = open_ & (total > 0) & (t > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(here, np.log10(np.where(c > 0, c, t) / (n + t)), 0)
        open_ &= ~(here & (c > 0))
        seen = total > 0
        hidden, hidden_n = np.where(seen, kinds, 0), np.where(seen, below, 0)
    left = ALPHABET - len(trie[0][0])
    return out - np.where(open_, np.log10(max(1, left)), 0)


def _occurrences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many occurrences in training each part of the tables stands for."""
    for batch in it:
        rows = [(k, p, int(np.frombuffer(c, np.int64).sum())) for k, p, c in zip(*(batch.column(c).to_pylist() for c in ("kind", "pid", "counts")), strict=True)]
        yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.int32()), "pid": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())})


class Table:
    """A lookup of 64-bit keys in an ascending array: a hashed slot names the place to try first, bisection finds the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.shift = U64(63 - min(40, len(keys).bit_length()))
        self.place = np.zeros(1 << (64 - int(self.shift)), np.int32 if len(keys) < 1 << 31 else np.int64)
        self.place[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * GOLD) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where it isn't there."""
        out = np.zeros(len(keys), self.values.dtype)
        if not len(self.keys):
            return out
        for a in range(0, len(keys), 1 << 17):
            part = keys[a : a + (1 << 17)]
            at = self.place.take(self._slot(part))
            hit = self.keys.take(at) == part
            out[a : a + len(part)] = np.where(hit, self.values.take(at), 0)
            rest = np.flatnonzero(~hit)
            again = part[rest]
            at = np.minimum(np.searchsorted(self.keys, again), len(self.keys) - 1)
            out[a + rest] = np.where(self.keys[at] == again, self.values[at], 0)
        return out


def _base(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))


def _summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between offsets; no run is empty."""
    return np.add.reduceat(values, at[:-1]) if len(at) > 1 else np.empty(0, values.dtype)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(it: Iterator[pa.RecordBatch], tables, n: int, v: int) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for batch in batches(whole, "text", 1 << 19):
            data, offsets = text_bytes(batch.column("text"))
            keys, at = grams(data, offsets)
            score = _summed(tables.value[0].get(keys), at)
            keys, at = tokens(data, offsets)
            c = tables.value[1].get(keys)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": np.diff(at), "n_known": _summed((c > 0).astype(np.int64), at), "base_score": _summed(_base(c, n, v), at), "score": score})


_DEALT = "kind int, pid int, slot int, base long, rows binary, least long, times binary, keys binary, ids binary, named binary, held binary"
_SUMS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _deal(it: Iterator[pa.RecordBatch], pids: int, shares: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct grams (kind 0) and tokens (kind 1) with how often they occur, packed by the part of the tables that knows them.

    A part that holds very much is dealt over several slots, batch by batch.
    A row's end token carries its doc_id and whether it is held out.
    """
    task = TaskContext.get().partitionId()
    first, number = task << 40, 0
    schema = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("slot", pa.int32()), ("base", pa.int64()), ("rows", pa.binary()), ("least", pa.int64()), *((c, pa.binary()) for c in ("times", "keys", "ids", "named", "held"))])
    for whole in it:
        for batch in batches(whole, "text", 1 << 21):
            data, offsets = text_bytes(batch.column("text"))
            ids, held = (batch.column(c) for c in ("doc_id", "held_out"))
            out = []
            for kind, (keys, at) in enumerate((grams(data, offsets), tokens(data, offsets))):
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.empty(0, np.int64)
                n = np.diff(np.append(start, len(keys)))
                keys, owner = keys[start], owner[start]
                part = _part(kind, keys, pids)
                by = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[by], np.arange(pids + 1))
                for pid in np.flatnonzero(np.diff(ends)).tolist():
                    mine = by[ends[pid] : ends[pid + 1]]
                    base, rows = packed(owner[mine] + first)
                    least, times = packed(n[mine])
                    row = {"kind": kind, "pid": pid, "slot": (number + task) % shares.get((kind, pid), 1), "base": base, "rows": rows, "least": least, "times": times, "keys": keys[mine].tobytes()}
                    last = mine[keys[mine] == END_TOKEN] if kind else mine[:0]
                    if len(last):
                        doc = ids.take(pa.array(owner[last]))
                        row |= {"ids": doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "named": doc.is_valid().to_numpy(zero_copy_only=False).tobytes(), "held": held.take(pa.array(owner[last])).to_numpy(zero_copy_only=False).tobytes()}
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
            first, number = first + batch.num_rows, number + 1


def _meet(dealt: pa.Table, known: pa.Table, n: int, v: int) -> pa.Table:
    """What the grams or tokens of a slot add to the sums of their rows."""
    names = [c.split()[0] for c in _SUMS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    if not dealt.num_rows:
        return schema.empty_table()
    kind = dealt.column("kind")[0].as_py()
    table = [np.frombuffer(b"".join(known.column(c).to_pylist()), t) for c, t in (("keys", U64), ("counts", np.float64 if kind == 0 else np.int64))]
    keys, rows, times, ended = [], [], [], []
    for r in dealt.to_pylist():
        k = np.frombuffer(r["keys"], U64)
        keys.append(k)
        rows.append(unpacked(r["base"], r["rows"], len(k)))
        times.append(unpacked(r["least"], r["times"], len(k)))
        if r["ids"] is not None:
            ended.append((rows[-1][k == END_TOKEN], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["named"], bool), np.frombuffer(r["held"], bool)))
    keys, rows, times = map(np.concatenate, (keys, rows, times))
    value = _find(table[0], [table[1]], keys)[0]
    own, place = np.unique(rows, return_inverse=True)
    summed = lambda x: np.bincount(place, x, len(own))
    whole = lambda x: summed(x).astype(np.int64)
    none = np.zeros(len(own))
    sums = [none.astype(np.int64), none.astype(np.int64), none, summed(times * value)] if kind == 0 else [whole(times), whole(times * (value > 0)), summed(times * _base(value, n, v)), none]
    out = [pa.table([pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.bool_()), *map(pa.array, sums)], schema)]
    for row, ids, named, held in ended:
        zero = np.zeros(len(row))
        out.append(pa.table([pa.array(row), pa.array(ids, mask=~named), pa.array(held), *(pa.array(zero.astype(np.int64)) for _ in range(2)), pa.array(zero), pa.array(zero)], schema))
    return pa.concat_tables(out)


def ppm_scores(docs: DataFrame, hold_out: int = 10, broadcast_entries: int = 6_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id long, text string).

    held_out: crc32 of the id as text, modulo hold_out, is 0; both models
    learn from all other rows, whole. score: log10 probability of the text
    (A-Z lower-cased, its end included) by the trie. base_score: the sum over
    words and end of log10((c + 0.1) / (N + 0.1 (V + 1))). The tables of grams
    and words are broadcast if each has at most broadcast_entries rows (16
    bytes a row). Larger ones stay in their parts: the distinct grams and words
    of each batch of documents are sent to the part that knows them, packed, a
    large part over several tasks, and only a sum for each document comes
    back, with the same result but for the order of sums. For that, rows are
    known by their place in the input, which must not change when it is read again.

    A null text is empty: an end alone. A null doc_id counts as the empty text
    in the choice of rows. Repeated rows are scored each and learnt each. If
    no row is for training, every symbol is as likely and base_score is 0. An
    empty table gives an empty one; other columns aren't read.
    """
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", hold_out) == 0).alias("held_out"))
    pids = 2 * partitions(docs)
    counted = source.mapInArrow(lambda it: _count(it, pids), _BLOBS)
    trie = cut(counted.groupBy("kind", "pid").applyInArrow(_merge, _BLOBS))
    sums = {r["what"]: r["n"] for r in trie.mapInArrow(_sums, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    n, v = sums.pop(-1, 0), sums.pop(-2, 0)
    low = np.zeros(1 << 16, np.int64)
    low[list(sums)] = list(sums.values())
    low = low.reshape(256, 256)

    def probabilities(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for kind, pid, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "pid", "keys", "counts")), strict=True):
                keys, counts = np.frombuffer(keys, U64), np.frombuffer(counts, np.int64)
                yield _blob(kind, pid, keys, log_probabilities(keys, counts, low) if kind == 0 else counts)

    priced = cut(trie.mapInArrow(probabilities, _BLOBS))
    sizes = {r["kind"]: r["n"] for r in priced.groupBy("kind").agg((F.sum(F.length("keys")) / 8).cast("long").alias("n")).collect()}
    if max(sizes.values(), default=0) <= broadcast_entries:
        held = {0: ([], []), 1: ([], [])}
        for r in priced.select("kind", "keys", "counts").toLocalIterator():
            held[r["kind"]][0].append(np.frombuffer(r["keys"], U64))
            held[r["kind"]][1].append(np.frombuffer(r["counts"], np.float64 if r["kind"] == 0 else np.int64))
        tables = [Table(np.concatenate([np.empty(0, U64), *held[k][0]]), np.concatenate([np.empty(0, t), *held[k][1]])) for k, t in ((0, np.float64), (1, np.int64))]
        held.clear()
        shared = docs.sparkSession.sparkContext.broadcast(tables)
        out = source.mapInArrow(lambda it: _score(it, shared, n, v), _SCORES)
    else:
        shares = {(r["kind"], r["pid"]): math.ceil(r["n"] / MEETING) for r in trie.mapInArrow(_occurrences, "kind int, pid int, n long").collect() if r["n"] > MEETING}  # of parts, not of documents
        slots_of = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("pid") == p), F.lit(n)) for (k, p), n in shares.items()), F.lit(1))
        dealt = source.mapInArrow(lambda it: _deal(it, pids, shares), _DEALT)
        known = priced.withColumn("slot", F.explode(F.sequence(F.lit(0), slots_of - 1)))
        key = ["kind", "pid", "slot"]
        met = dealt.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(lambda a, b: _meet(a, b, n, v), _SUMS)
        out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))).drop("row")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
