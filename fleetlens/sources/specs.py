"""Experiment spec scan.

Reads a glob of JSON spec files, one experiment per file, with an explicit
schema.  Inference would turn ``tasks`` into a struct whose fields are sorted
by name (``1, 10, 2``), losing the start order; as a ``map`` the entry order
of the file is kept.  The file path is the run id.

Each file is read whole (``wholetext``) and parsed twice in the same pass: once
with the typed schema and once with ``obj_config`` as a string map, because a
struct cannot tell an absent key from a null one, and ``host`` needs that
difference (absent -> ``''``, present null -> ``None`` text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, MapType, StringType,
                               StructField, StructType)

S = StringType()
STRMAP = MapType(S, S, True)

OBJ_CONFIG = StructType([
    StructField("path", S), StructField("port", S), StructField("interface", S),
    StructField("tracefile_path", S), StructField("type", S), StructField("host", S),
    StructField("attrs_values", STRMAP), StructField("options_values", STRMAP),
])
RUNNER_CONFIG = StructType([
    StructField("username", S), StructField("host", S), StructField("collect_results_path", S),
])
TASK = StructType([
    StructField("obj_type", S), StructField("obj_config", OBJ_CONFIG),
    StructField("runner_type", S), StructField("runner_config", RUNNER_CONFIG),
    StructField("sleep_after_start", IntegerType()), StructField("sleep_after_stop", IntegerType()),
    StructField("stop_order", IntegerType()),
])
SPEC = StructType([
    StructField("collect_results_path", S), StructField("stop_after", IntegerType()),
    StructField("ignore_stop_order", BooleanType()), StructField("tasks", MapType(S, TASK, True)),
])
# second parse: which keys each task's obj_config / runner_config actually has
SPEC_KEYS = StructType([StructField("tasks", MapType(S, StructType([
    StructField("obj_config", STRMAP), StructField("runner_config", STRMAP)]), True))])

TASK_WITH_KEYS = StructType(TASK.fields + [
    StructField("obj_config_keys", ArrayType(S)), StructField("runner_config_keys", ArrayType(S))])


CORRUPT = "_corrupt_record"


def decoded(path):
    """A file's path from its URL form."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _empty_files(spark: SparkSession, glob: str) -> list[str]:
    """Files of length 0, which Spark's sources skip (from the listing; only their names come here)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found if f.isFile() and f.getLen() == 0]


def read_specs(spark: SparkSession, glob: str, json_lines: bool = False) -> DataFrame:
    """``run``, ``collect_results_path``, ``stop_after``,
    ``ignore_stop_order``, ``tasks`` (ordered map of task structs, each with
    ``obj_config_keys`` / ``runner_config_keys``), ``malformed``, ``error``.

    One spec per file (``run`` = decoded file path), or with ``json_lines`` one spec
    per line, which splits large spec sets across tasks (``run`` = the spec's
    results path, which names its run; of a line without one, a hash of the line).
    Every file and line gives a row: ``error`` is ``empty``, ``invalid_json`` or ``no_tasks`` for
    those that hold no tasks (``operators.specs.spec_rejects``)."""
    if json_lines:
        named = F.regexp_extract("value", r'"collect_results_path"\s*:\s*"([^"]*)"', 1)
        # of a line that can't be parsed, what stands there; of any other, the spec's own path (runners' have the same name)
        raw = spark.read.text(glob).select(F.lit(None).cast("string").alias("run"), "value")
    else:
        raw = (spark.read.text(glob, wholetext=True)
                    .select(decoded(F.col("_metadata.file_path")).alias("run"), "value"))
        raw = raw.unionByName(spark.createDataFrame([(p, "") for p in _empty_files(spark, glob)], "run string, value string"))
    typed = StructType(SPEC.fields + [StructField(CORRUPT, S)])
    p = raw.select("run", "value", F.from_json("value", typed, {"columnNameOfCorruptRecord": CORRUPT}).alias("s"),
                   F.from_json("value", SPEC_KEYS).alias("k"))
    keyed = F.transform_values(
        F.col("s.tasks"),
        lambda k, v: v.withField("obj_config_keys",
                                 F.map_keys(F.element_at(F.col("k.tasks"), k)["obj_config"]))
                      .withField("runner_config_keys",
                                 F.map_keys(F.element_at(F.col("k.tasks"), k)["runner_config"])))
    error = F.when(F.trim("value") == "", "empty").when(F.col("s").isNull() | F.col(f"s.{CORRUPT}").isNotNull(), "invalid_json") \
             .when(F.coalesce(F.size("s.tasks"), F.lit(0)) <= 0, "no_tasks")
    run = F.col("run")
    if json_lines:
        run = F.coalesce("s.collect_results_path", F.when((error == "invalid_json") & (named != ""), named), F.concat(F.lit("line:"), F.md5("value")))
    return p.select(run.alias("run"), F.col("s.collect_results_path").alias("collect_results_path"),
                    F.col("s.stop_after").alias("stop_after"),
                    F.col("s.ignore_stop_order").alias("ignore_stop_order"),
                    F.when(error.isNull(), keyed).alias("tasks"), error.isNotNull().alias("malformed"), error.alias("error"))
