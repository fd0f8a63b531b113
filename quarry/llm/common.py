"""Shared plumbing: checkpoints, Arrow text buffers and vectorised word scanning.

Text is handled as UTF-8 bytes straight from the Arrow buffers, so that a
batch costs a few NumPy passes and no Python string per document.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
#: Bytes handled by one NumPy pass; temporaries are about 30 times as large.
SLICE = 1 << 20
#: Rows of numbers that a join broadcasts at most (a few MB).
BROADCAST_ROWS = 50_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x2545F4914F6CDD1D)
_BASE_INV = U64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the shared one that it names, or in local mode, where all share one machine, a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the reliable checkpoint folder; its lineage ends there. Its rows are counted on the way, for rows_of()."""
    checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    out._cut_rows = seen.get.get("rows")
    return out


def rows_of(df: DataFrame, most: int) -> int:
    """Rows of df, at most + 1 if they are more than that; known without a job for what cut() gave."""
    known = getattr(df, "_cut_rows", None)
    return df.limit(most + 1).count() if known is None else known


def drop_cut(*frames: DataFrame) -> None:
    """Removes the files of frames that cut() gave and that nothing reads any more."""
    for df in frames:
        kept = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if kept.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def near(df: DataFrame, rows: int = BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows by count; a larger one is joined by shuffle. of: a cut frame that has as many rows."""
    return F.broadcast(df) if rows_of(df if of is None else of, rows) <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until they are no columns of df, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list:
    """Columns of these names, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands rows to Python a thousand at a time at most, as rows may hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= 1000:
        df.sparkSession.conf.set(name, "1000")
    return df


def partitions(df: DataFrame) -> int:
    """Number of partitions of an input frame (a scan or a checkpoint)."""
    return max(1, df._jdf.rdd().getNumPartitions())


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """The least of int64 values, and of each value its distance from it in as few bytes as the largest distance needs."""
    base = int(values.min())
    far = values.view(U64) - values.min().view(U64)
    width = max(1, (int(far.max()).bit_length() + 7) // 8)
    return base, far.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(base: int, data: bytes, n: int) -> np.ndarray:
    """What packed() was given, n values."""
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return (out.view(U64).ravel() + np.array([base], np.int64).view(U64)).view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def batches(batch: pa.RecordBatch, column: str, limit: int = 8 * SLICE) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about `limit` bytes of text each, or one longer row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (_BASE, _BASE_INV)]
    return _POWERS


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes outside 0x20, 0x09-0x0D."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that split no word: they end at a row's end or at white space."""
    pos, n = 0, len(data)
    while pos < n:
        end = min(pos + SLICE, n)
        if end < n:
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if row > pos:
                end = row
            else:
                space = np.flatnonzero(_SPACE[data[pos:end]])
                if len(space):
                    end = pos + int(space[-1]) + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, end, "right")])
                    space = np.flatnonzero(_SPACE[data[end:stop]])
                    end = end + int(space[0]) + 1 if len(space) else stop
        yield pos, end
        pos = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and its row; words as in word_spans.

    A polynomial over random odd codes of the bytes, taken from prefix sums
    modulo 2^64 and finalised with the word's length.
    """
    hashes, rows = [], []
    with np.errstate(over="ignore"):
        for a, b in _cuts(data, offsets):
            part = data[a:b]
            lo, hi = np.searchsorted(offsets, [a, b], "right")
            inner = np.concatenate([[0], offsets[lo:hi] - a])
            starts, ends, _ = word_spans(part, inner[inner <= len(part)])
            power, inverse = _powers(len(part) + 1)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_CODE[_LOWER[part]] * power[: len(part)], out=total[1:])
            h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * GOLD
            hashes.append(mix(h))
            rows.append(np.searchsorted(offsets, starts + a, "right") - 1)
    if not hashes:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def words_per_row(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each row."""
    total = np.zeros(len(offsets) - 1, np.int64)
    for a, b in _cuts(data, offsets):
        lo, hi = np.searchsorted(offsets, [a, b], "right")
        inner = np.concatenate([[0], offsets[lo:hi] - a])
        starts, _, _ = word_spans(data[a:b], inner[inner <= b - a])
        rows = np.searchsorted(offsets, starts + a, "right") - 1
        total += np.bincount(rows, minlength=len(total))
    return total


def slots(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets, n + 1 of them, of the runs of equal values in the ascending array rows of 0..n-1."""
    return np.searchsorted(rows, np.arange(n + 1))
