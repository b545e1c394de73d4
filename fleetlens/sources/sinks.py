"""Fail-if-exists sink.

A results directory or a generated spec must not exist yet; existing content
is never deleted or overwritten.  Of two writers at once one is refused: each first makes a claim, an empty file
beside the target that a file system creates only once, and the one that can't does not write.  A claim goes with the end of
its write, done or failed; that of a driver that was lost stays, and its target is refused until the
claim (``.<name>.claim``) is taken away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Claimed(RuntimeError):
    """Another writer holds the target."""


def _create_new(spark: SparkSession, path, fs) -> bool:
    """Creates an empty file; False if there is one."""
    if fs.getScheme() == "file":  # java.io's is atomic, Hadoop's local one is not
        return spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    return fs.createNewFile(path) if fs.getScheme() != "hdfs" else _exclusive(fs, path)


def _exclusive(fs, path) -> bool:
    from py4j.protocol import Py4JJavaError
    try:
        fs.create(path, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, **options) -> None:
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = fs.makeQualified(target)
    claim = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.claim")
    fs.mkdirs(target.getParent())
    if not _create_new(spark, claim, fs):
        raise Claimed(f"{path} is being written by another writer")
    try:
        w = df.write.mode("errorifexists").format(fmt).options(**options)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(path)
    finally:
        fs.delete(claim, False)
