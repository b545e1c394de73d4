"""Run a streaming query to completion into the shared folder.

The sink is a parquet folder with its checkpoint under the session's shared
checkpoint folder (``spark.checkpoint.dir``), so a restarted job resumes from
the checkpoint and the file sink's log gives exactly-once output.  The
``availableNow`` trigger drains what is there (in as many micro-batches as
the source's rate limits ask for) and stops.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import shared_dir, state_conf

PROGRESS_S = 2.0  # how often a drain looks at the progress


def drain_to_parquet(spark: SparkSession, stream: DataFrame, name: str,
                     out: str | None = None, checkpoint: str | None = None,
                     timeout_s: float | None = None, dropped: dict | None = None) -> DataFrame:
    """Drain the stream and return what it wrote.  Waits to the end; with ``timeout_s``, a stream
    that is not done by then is stopped and a TimeoutError raised, so a partial
    folder is never taken for the result.  ``dropped`` is given the rows that came behind the watermark,
    and so are in no result: ``{"late_rows": n}``."""
    base = shared_dir(spark, name)
    out = out or f"{base}/out"
    checkpoint = checkpoint or f"{base}/checkpoint"
    w = (stream.writeStream.format("parquet").outputMode("append")
               .option("path", out).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True))
    with state_conf(spark):  # a query keeps the settings that it is started with
        q = w.start()
    try:
        late, until = {}, None if timeout_s is None else time.monotonic() + timeout_s
        while True:
            wait = PROGRESS_S if until is None else max(0.001, min(PROGRESS_S, until - time.monotonic()))
            done = q.awaitTermination(wait)
            late |= _late(q)  # the query keeps the progress of its last batches only
            if done or until is not None and time.monotonic() >= until:
                break
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if not done:
        raise TimeoutError(f"{name}: not drained after {timeout_s} s")
    if dropped is not None:
        dropped["late_rows"] = sum(late.values())
    return spark.read.schema(stream.schema).parquet(out)


def _late(q) -> dict[int, int]:
    """Rows dropped behind the watermark, by micro-batch."""
    return {p["batchId"]: sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]) for p in q.recentProgress}


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def table_stream(spark: SparkSession, base: str, name: str, schema,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the table ``<base>/<name>.parquet``, be it a file or a folder of parts."""
    base = base.rstrip("/")
    path = f"{base}/{name}.parquet"
    if _is_folder(spark, path):
        return file_stream(spark, path, schema, max_files_per_trigger=max_files_per_trigger)
    return file_stream(spark, base, schema, glob=f"{name}.parquet", max_files_per_trigger=max_files_per_trigger)
