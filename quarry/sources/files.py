"""Files on disk as tables: scans, statistics, bundles, reconciliation with the registry, packages."""

from __future__ import annotations

import os
import zipfile
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import base_name, folder, human_size, inside, safe_entry, supported
from quarry.functions.text import file_type
from quarry.operators.quality import clean

#: Folders that a scan leaves out, besides those with a leading dot.
SET_ASIDE = ["duplicates_files", "duplicates", "blocked_files", "blocked"]
#: Files that the operating system leaves in folders.
LITTER = ["Thumbs.db", ".DS_Store", "desktop.ini"]


def read_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, mtime_ms, size) of all files below root, with their bytes if asked for; without them no file is opened.

    Spark's listing itself leaves out names with a leading dot or underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    out = [path.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size")]
    return files.select(*out, *(["content"] if content else []))


def scan(files: DataFrame, root: str, ignore: str | None = None) -> DataFrame:
    """Files below root that are read: of a supported type, and in no folder that is set aside, hidden or ignored."""
    below = F.split(F.substr(folder(F.col("path")), F.lit(len(root) + 2)), "/")
    aside = F.exists(below, lambda d: d.startswith(".") | d.isin(SET_ASIDE))
    out = files.where(F.col("path").startswith(root + "/") & supported(base_name(F.col("path"))) & ~aside)
    return out.where(~inside(F.col("path"), ignore)) if ignore else out


def scan_all(files: DataFrame) -> DataFrame:
    return files.where(supported(base_name(F.col("path"))))


def extracted(files: DataFrame) -> DataFrame:
    """(path, checksum, text) of text files read with their bytes: the digest of the bytes and the cleaned text."""
    return files.select("path", F.sha2("content", 256).alias("checksum"), clean(F.decode("content", "UTF-8")).alias("text"))


def directory_stats(files: DataFrame) -> DataFrame:
    """(format, n, bytes, human): files by kind, and all of them with a null kind. Kinds are few, so the second sum is small."""
    rows = files.select(F.lower(file_type(F.col("path"))).alias("format"), "size")
    out = rows.rollup("format").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return out.withColumn("human", human_size(F.col("bytes")))


def image_bundles(files: DataFrame, root: str) -> DataFrame:
    """(dir, n) of folders that hold two images or more and no other files: each is one document.

    Folders below a bundle belong to it, and hidden folders are not looked
    into. Each candidate is joined by its own ancestors, which are as few as
    its path is deep.
    """
    name, parent = base_name(F.col("path")), folder(F.col("path"))
    rows = files.where(F.col("path").startswith(root + "/") & ~name.isin(LITTER)).select(parent.alias("dir"), F.when((file_type(name) == "IMAGE"), 1).otherwise(0).alias("image"))
    below = F.split(F.substr("dir", F.lit(len(root) + 2)), "/")
    seen = rows.where((F.col("dir") != root) & ~F.exists(below, lambda d: d.startswith(".")))
    full = seen.groupBy("dir").agg(F.count("*").alias("n"), F.sum("image").alias("images")).where("images >= 2 AND images = n")
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    under = full.select(F.col("dir").alias("own"), F.explode(ancestors).alias("dir")).join(full.select("dir"), "dir", "left_semi").select(F.col("own").alias("dir"))
    return full.select("dir", "n").join(under.distinct(), "dir", "left_anti")


def reconciled(registry: DataFrame, disk: DataFrame) -> DataFrame:
    """(checksum, id, path, state) from (id, checksum, new_path) and (path, checksum).

    ghost: no file has the row's checksum; unindexed: no row has the file's;
    matched: the file is where the row says; moved: it is elsewhere. Of rows
    with one checksum the first counts, so a file meets one row at most.
    """
    rows = registry.groupBy("checksum").agg(F.min_by(F.struct("id", "new_path"), "id").alias("r"))
    met = rows.join(disk.select("checksum", "path"), "checksum", "full_outer")
    state = F.when(F.col("path").isNull(), "ghost").when(F.col("r").isNull(), "unindexed").when(F.col("r.new_path") == F.col("path"), "matched").otherwise("moved")
    return met.select("checksum", F.col("r.id").alias("id"), "path", state.alias("state"))


def located(docs: DataFrame, disk: DataFrame, input_dir: str) -> DataFrame:
    """(id, found): where the file of (id, new_path, original_path, original_filename) is.

    The new path, else the original one, else the name in the input folder,
    else any file of that name, letters of either case, the first by path;
    null if there is none.
    """
    name = F.when(F.coalesce("original_filename", F.lit("")) == "", base_name(F.col("original_path"))).otherwise(F.col("original_filename"))
    rows = docs.select("id", "new_path", "original_path", F.concat(F.lit(input_dir + "/"), name).alias("input_path"), F.lower(name).alias("name"))
    there = disk.select("path").distinct()
    for c in ("new_path", "original_path", "input_path"):
        rows = rows.join(there.select(F.col("path").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    by_name = there.groupBy(F.lower(base_name(F.col("path"))).alias("name")).agg(F.min("path").alias("anywhere"))
    rows = rows.join(by_name, "name", "left")
    return rows.select("id", F.coalesce(*(F.when(F.col(f"_{c}"), F.col(c)) for c in ("new_path", "original_path", "input_path")), "anywhere").alias("found"))


def packaged(docs: DataFrame, ids: list[int]) -> DataFrame:
    """(ord, id, name, missing) of the ids asked for, in their order: what a package holds and what it lacks."""
    asked = docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(ids)], "ord int, id long")
    found = docs.where(F.col("id").isin(ids)).select("id", safe_entry(F.col("original_filename")).alias("name"))
    return asked.join(found, "id", "left").select("ord", "id", F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNull().alias("missing"))


def write_package(entries: DataFrame, out: BinaryIO) -> int:
    """Writes (name, content) as a stored archive, a row at a time, and returns the number of entries.

    Rows without content are left out; an empty name is document.pdf, and a
    name that is taken gets a number.
    """
    taken: dict[str, int] = {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for row in entries.select("name", "content").toLocalIterator():
            if row["content"] is None:
                continue
            name = row["name"] or "document.pdf"
            taken[name] = taken.get(name, 0) + 1
            stem, ext = os.path.splitext(name)
            archive.writestr(name if taken[name] == 1 else f"{stem}_{taken[name]}{ext}", bytes(row["content"]))
    return sum(taken.values())
