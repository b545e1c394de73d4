"""Catalog of collected files (path, size, time), never their content.

The spec runner asks "does this file exist?" once per artifact.  Here a
collected tree is listed once, as a table, which ``operators.reconcile`` joins
against.  The ``binaryFile`` source lists files in parallel; selecting only
metadata columns prunes ``content`` from the read schema, so no bytes are
read.  For trees with very many files, listing on the driver is the limit:
``list_tree`` lists in tasks, folder by folder, and ``from_listing`` takes a
listing made elsewhere.

Spark's recursive listing skips names starting with ``_`` or ``.``, and run
folders are commonly named ``_<param><value>...``: give ``depth`` (files that
many levels below ``root``) to glob straight to the files, which globbing does
not filter.
"""

from __future__ import annotations

import fnmatch
import os
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.session import local_path, shared_dir

LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("ms", pa.int64())])
LISTED_DDL = "path string, folder boolean, length bigint, ms bigint"
LISTED_ROWS = 10_000   # of one Arrow batch
FOLDERS_A_TASK = 16


def from_listing(listing: DataFrame, path: str = "path", length: str | None = None, mtime: str | None = None) -> DataFrame:
    """A catalog from a prebuilt listing table (one row per file), for trees too large to list from the driver."""
    given = lambda c, t: F.col(c).cast(t) if c else F.lit(None).cast(t)
    return listing.select(F.col(path).alias("path"), F.regexp_replace(F.col(path), r"^file:", "").alias("local_path"),
                          given(length, "bigint").alias("length"), given(mtime, "timestamp").alias("mtime"))


def file_catalog(spark: SparkSession, root: str, glob: str | None = None,
                 depth: int | None = None) -> DataFrame:
    r = spark.read.format("binaryFile")
    base = root.rstrip("/")
    if depth is None:
        r = r.option("recursiveFileLookup", True)
        if glob:
            r = r.option("pathGlobFilter", glob)
        df = r.load(base)
    else:
        leaf = glob or "*"
        df = r.load("/".join([base] + ["*"] * (depth - 1) + [leaf]))
    return df.select(
        F.col("path"),
        F.regexp_replace(F.col("path"), r"^file:", "").alias("local_path"),
        F.col("length"), F.col("modificationTime").alias("mtime")) \
        .withColumn("rel_path", F.expr(f"substring(local_path, {len(local_path(base)) + 2})"))


def _file_system(root: str):
    """The file system of ``root``, and what stands before its paths in the catalog's ``path``."""
    if "://" not in root or root.startswith("file:"):
        return fs.LocalFileSystem(), "file:"
    files, base = fs.FileSystem.from_uri(root)
    return files, root.removesuffix("/").removesuffix(base.removesuffix("/"))


def _listed(root: str, first: bool):
    """Arrow batches of folders to batches of what lies in them."""
    def run(batches):
        files, prefix = _file_system(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                # a folder that was there in the last round and is gone now is empty; the root must be there
                infos = files.get_file_info(fs.FileSelector(folder.removeprefix(prefix), allow_not_found=not first))
                for i in range(0, len(infos), LISTED_ROWS):
                    rows = []
                    for info in infos[i:i + LISTED_ROWS]:
                        if info.type == fs.FileType.File:
                            rows.append((prefix + info.path, False, info.size, None if info.mtime_ns is None else info.mtime_ns // 1_000_000))
                        elif info.type == fs.FileType.Directory and not (prefix == "file:" and os.path.islink(info.path)):
                            rows.append((prefix + info.path, True, None, None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LISTED)] if rows else
                                                     [pa.array([], f.type) for f in LISTED], schema=LISTED)
    return run


def list_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The catalog of ``file_catalog``, listed by tasks: a round for each level of the tree, its folders dealt over tasks.

    Each round is written to the shared folder and the next starts from what is there; only the number of
    folders comes to the driver.  Unlike Spark's listing it has empty files and names that start with ``_`` or ``.``;
    linked folders of a local tree are not followed.  ``glob`` (``*``, ``?``, ``[]``) is for file names.
    A missing root is an error; files that go while the tree is listed may or may not be in it."""
    out, level, folders = shared_dir(spark, "listing"), 0, 1
    base = root.rstrip("/")
    if _file_system(base)[1] == "file:":
        base = "file:" + os.path.abspath(re.sub("^/+", "/", local_path(base)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = spark.range(1).select(F.lit(base).alias("path"))
    while folders:
        dealt = todo.repartition(max(1, min(parts, -(-folders // FOLDERS_A_TASK))), "path")
        dealt.mapInArrow(_listed(base, level == 0), LISTED_DDL).write.parquet(f"{out}/level={level}")
        todo = spark.read.schema(LISTED_DDL).parquet(f"{out}/level={level}").where("folder").select("path")
        folders, level = todo.count(), level + 1
    found = spark.read.schema(LISTED_DDL).parquet(*[f"{out}/level={i}" for i in range(level)]).where("NOT folder")
    if glob:
        found = found.where(F.regexp_extract("path", "([^/]*)$", 1).rlike("^" + fnmatch.translate(glob).replace(r"\Z", r"\z")))
    return found.select("path", F.regexp_replace("path", "^file:", "").alias("local_path"), "length", F.timestamp_millis("ms").alias("mtime")) \
        .withColumn("rel_path", F.expr(f"substring(path, {len(base) + 2})"))
