"""S3: statistics ingest.

Loads the collected statistics / metrics CSVs of all runs as one table, with
lineage ``run``, ``origin`` and ``file`` parsed from the collected layout
``<root>/<run>/<origin>/<file>`` (``depth=2``; a flattened tree
``<root>/<run>/<file>`` is ``depth=1``; a ``name=value`` folder also works).
The CSV columns are not fixed anywhere, so files are merged by column name: files of one run may have other
columns, or the same in another order.

All files are one scan, which reads columns by place, as text; the reader drops each file's first line.
A second, narrow scan gives each file's header, and the two are joined by file: by broadcast up to ``BROADCAST_FILES`` files, by shuffle
beyond, where a very large file is only a hot key of a plain join.  Every wanted column is then picked by its place in
the row's own header, and typed by the CSV reader's rules.  So no list of files passes through the driver, and there may be any
number of kinds of files; the driver learns the largest number of columns and, without a schema, their names.

Without a schema, a column has the first of INT, BIGINT, DOUBLE, TIMESTAMP and BOOLEAN that all its values in all files can be
read as, else STRING.

Run folders are commonly named ``_<param><value>...``; Spark's directory
listing skips names starting with ``_``, so the reader globs straight to the
leaf files, which globbing does not filter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources.specs import decoded

BROADCAST_FILES = 50_000  # a path and a header each: some 20 MB
INFERRED = ("INT", "BIGINT", "DOUBLE", "TIMESTAMP", "BOOLEAN")
_FILE = "_metadata.file_path"


def _lineage(depth: int) -> list:
    """Counted from the file's end of the path, so the root may be written in any way."""
    parts = F.split(decoded(F.col("_metadata.file_path")), "/")
    seg = lambda i: F.regexp_replace(F.element_at(parts, -i), "^[^=/]*=", "")
    origin = seg(2) if depth >= 2 else F.lit(None).cast("string")
    return [seg(depth + 1).alias("run"), origin.alias("origin"), F.element_at(parts, -1).alias("file")]


def _plain(options: dict) -> dict:
    """Options of the reader that say how text is cut, not how values are typed."""
    return {k: v for k, v in options.items() if not re.search("format|infer|header|schema|nullvalue|nanvalue|inf$", k.lower())}


def _headers(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
    """``hfile`` (encoded path) and ``names`` (its columns, in order) of each file with a line, stored."""
    lines = spark.read.options(**{k: v for k, v in options.items() if k.lower() in ("encoding", "linesep", "pathglobfilter")}) \
        .option("recursiveFileLookup", True).text(paths)
    first = lines.select("value", F.monotonically_increasing_id().alias("at"), F.col(_FILE).alias("hfile")) \
        .where(F.col("_metadata.file_block_start") == 0).groupBy("hfile").agg(F.min_by("value", "at").alias("header"))
    sep = options.get("sep", options.get("delimiter", ","))
    width = first.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(sep), F.lit(""))))).first()[0]
    every = StructType([StructField(f"c{i}", StringType()) for i in range((width or 0) // max(len(sep), 1) + 1)])
    cut = F.from_csv("header", every.simpleString()[7:-1].replace(":", " "), _plain(options))
    names = F.filter(F.array(*[cut[f.name] for f in every]), lambda n: n.isNotNull())
    ensure_checkpoint_dir(spark)
    return first.select("hfile", names.alias("names")).checkpoint(eager=True)


def _inferred(rows: DataFrame, value, names: list[str]) -> StructType:
    """Types that all values of a column can be read as."""
    fits = [F.coalesce(F.bool_and(value(n).isNull() | F.trim(value(n)).try_cast(t).isNotNull() & (F.lit(t != "TIMESTAMP") | value(n).contains("-"))), F.lit(False))
            for n in names for t in INFERRED]
    some = rows.agg(*[c.alias(f"f{i}") for i, c in enumerate(fits)], *[F.count(value(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    out = []
    for i, n in enumerate(names):
        own = [t for j, t in enumerate(INFERRED) if some[f"f{i * len(INFERRED) + j}"] and some[f"n{i}"]]
        out.append(f"`{n.replace('`', '``')}` {own[0] if own else 'STRING'}")
    return StructType.fromDDL(", ".join(out))


def read_stats(spark: SparkSession, root: str, globs=("*.csv",), schema=None,
               depth: int = 2, **options) -> DataFrame:
    """``run``, ``origin``, ``file`` and the columns, by name.  With ``schema`` (a DDL string or a
    StructType) its columns with its types, null where a file lacks one; ``options`` go to the CSV
    reader (formats, separators, ...)."""
    levels = "/".join(["*"] * depth)
    paths = [f"{root.rstrip('/')}/{levels}/{g}" for g in globs]
    headers = _headers(spark, paths, options)
    n_files, width = headers.agg(F.count(F.lit(1)), F.max(F.size("names"))).first()
    if not n_files:
        raise ValueError(f"no statistics files under {root}")
    by_place = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    # recursive lookup keeps name=value folders from being read as partition columns
    raw = spark.read.options(**_plain(options)).option("header", True).option("recursiveFileLookup", True).option("enforceSchema", True) \
        .schema(by_place).csv(paths)
    rows = raw.select(*_lineage(depth), F.col(_FILE).alias("rfile"), F.array(*[f.name for f in by_place]).alias("cells"))
    rows = rows.join(F.broadcast(headers) if n_files <= BROADCAST_FILES else headers, F.col("rfile") == F.col("hfile"))

    def value(name: str) -> Column:
        return F.get("cells", F.array_position("names", F.lit(name)) - 1)

    if schema is None:
        named = [r["n"] for r in headers.select(F.explode("names").alias("n")).groupBy("n").count().orderBy("n").select("n").collect()]
        wanted = _inferred(rows, value, named)
    else:
        wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    # written as a line in the wanted order, and read by the reader's own rules
    text = F.to_csv(F.struct(*[value(f.name).alias(f"c{i}") for i, f in enumerate(wanted)]))
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(wanted))
    typed = F.from_csv(text, ddl, {k: v for k, v in options.items() if k not in _plain(options)})
    return rows.select("run", "origin", "file", typed.alias("t")) \
        .select("run", "origin", "file", *[F.col(f"t.c{i}").alias(f.name) for i, f in enumerate(wanted)])
