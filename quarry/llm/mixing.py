"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import batches, cut, fresh, quoted, small_batches, text_bytes, words_per_row

#: First bits of a hash key by which the sums of a source are kept.
RANGE_BITS = 12


def word_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs and size long, the words of text (runs outside 0x20, 0x09-0x0D); null has none."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in batches(whole, "_text"):
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"size": words_per_row(*text_bytes(batch.column("_text")))})

    source = small_batches(docs).select(*keep, F.col("text").cast("string").alias("_text"))
    types = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "_text")
    return source.mapInArrow(run, f"{types}, size long")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): `share` of all words, dealt by weight.

    Weights go round the sources by code point, null last. A target stops at
    `epochs` times its source's size and the excess is dealt again by weight
    until no target is above: in order of size per weight, the first sources
    are at their caps and the rest share what is left in proportion. If
    nothing is left to give, the caps stand. One row for each source.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    filled = Window.orderBy((F.col("cap") / F.col("w")).asc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    return (
        totals.withColumn("place", F.row_number().over(place) - 1)
        .withColumn("w", pick)
        .withColumn("cap", F.col("source_size").cast("double") * epochs)
        .withColumn("goal", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("capped", F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filled), F.lit(0.0)))
        .withColumn("level", F.greatest(F.lit(0.0), F.col("goal") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level"))).over(everything))
        .select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))
    )


def cuts(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row for each source of sizes (source, key, size): how often it is taken whole, and where it is cut.

    (source, source_size, target, whole, at, rest): every document is taken
    `whole` times, once more if its key is below `at`, and of the document at
    the key `at` there are `rest` words more. Sums of ranges of keys give the
    range that holds the cut; only that range's documents are put in order.
    """
    ranged = sizes.withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS).cast("int"))
    sums = cut(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    budget = F.floor("target").cast("long")
    goal = cut(goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")).withColumn("left", budget - F.col("whole") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = goal.withColumnRenamed("source", "_source")
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    hit = before.join(named, same("source", "_source")).where("before <= left AND left < before + words").select(F.col("source").alias("_of"), F.col("range").alias("_range"), F.col("left") - F.col("before"))
    hit = hit.toDF("_of", "_range", "_left")
    inner = ranged.join(hit, same("source", "_of") & (F.col("range") == F.col("_range"))).groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("_left").alias("_left"))
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    edge = inner.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where("before <= _left AND _left < before + size")
    edge = edge.select(F.col("source").alias("_source"), F.col("key").alias("at"), (F.col("_left") - F.col("before")).alias("rest"))
    return cut(goal.join(edge, same("source", "_source"), "left").select("source", "source_size", "target", "whole", "at", F.coalesce("rest", F.lit(0)).alias("rest")))


def _on_source(rows: DataFrame, column: str, edges: DataFrame, named: str, most: int = 100_000) -> DataFrame:
    """rows joined with the one row of edges for their source, null with null; edges is broadcast up to `most` sources."""
    small = edges.limit(most + 1).count() <= most
    return rows.join(F.broadcast(edges) if small else edges, F.col(column).eqNullSafe(F.col(named)))


def _key(seed: int):
    """A hash-random key: of the id, so that reruns agree, with the text where ids are null."""
    return F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id long, text string, source string).

    See targets() and cuts(). taken counts the words that the mix takes of a
    row, repeats counted; of the one document at a source's cut it takes the
    words that fill the budget exactly, so a source's taken words add up to
    floor(target) and no row exceeds `epochs` times its size. Null and blank
    texts have size 0 and give nothing; null is a source like others, last in
    order. Rows with one doc_id and source are drawn together, and share what
    is taken at the cut by their order of size. An empty table gives an empty
    one; other columns aren't read. Keys are hashed in the order of unsigned
    integers.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).withColumn("key", _key(seed))
    sizes = cut(word_sizes(keyed, "doc_id", "source", "key"))
    edges = cuts(sizes, weights, share, epochs).withColumnRenamed("source", "_source")
    joined = _on_source(sizes, "source", edges, "_source")
    at, key = (F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in ("at", "key"))
    inside = F.col("at").isNotNull() & (key < at)
    # rows that share the key of a cut share its words one after the other
    twins = joined.where("key = at").withColumn("_no", F.coalesce(F.sum("size").over(Window.partitionBy("source", "key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("_no")))
    cols = ["doc_id", "size", "source_size", "target"]
    plain = joined.where("at IS NULL OR key <> at").select(*cols, (F.col("size") * (F.col("whole") + inside.cast("long"))).alias("taken"))
    return plain.unionByName(twins.select(*cols, (F.col("size") * F.col("whole") + part).cast("long").alias("taken")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, whole.

    The document at a source's cut is taken once more if at least half of it
    fits the budget. Rows without words (null, blank) are never taken; null is
    a source like others; rows repeated with one doc_id are drawn together.
    Rows come out with all their columns as they were, whatever the names. An
    empty table gives an empty one. Only the table of cuts, one row for each
    source, meets the texts; they aren't shuffled by key.
    """
    origin, key, of, whole, at, half, copy = fresh(docs, "_source", "_key", "_of", "_whole", "_at", "_half", "_copy")
    base = docs.withColumns({origin: F.col("source").cast("string"), key: _key(seed)})
    sizes = cut(word_sizes(base.select(F.col(origin).alias("source"), F.col(key).alias("key"), "text"), "source", "key"))
    edges = cuts(sizes, weights, share, epochs)
    cut_at = edges.select(F.col("source").alias("_s"), "at", "rest")
    fits = sizes.join(cut_at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("at"))).groupBy("source").agg((F.first("rest") * 2 >= F.sum("size")).cast("long").alias("half")).withColumnRenamed("source", "_h")
    edges = cut(edges.join(fits, F.col("source").eqNullSafe(F.col("_h")), "left").select("source", "whole", "at", F.coalesce("half", F.lit(0))).toDF(of, whole, at, half))
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    more = F.when(F.col(at).isNull(), 0).when(flip(key) < flip(at), 1).when(F.col(key) == F.col(at), F.col(half)).otherwise(0)
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    times = F.array_repeat(F.lit(1), (F.col(whole) + more).cast("int"))
    return _on_source(base, origin, edges, of).where(worded).withColumn(copy, F.explode(times)).select(*quoted(*docs.columns))
