"""From raw documents to a mixed and sharded training corpus, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of their
input.  Stages read ``docs`` more than once where a decision needs the whole corpus first.

Defined results: empty tables pass through as empty; columns that an operator would
name for itself are kept apart and come back unchanged, but for ``slot`` and ``shard``, which the
last stage sets; nulls and repeated rows as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import decontaminate, mixing, quality, sharding, simhash
from fleetlens.llm.frames import apart
from fleetlens.session import shared_dir
from fleetlens.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the fitted rules take for bad go."""
    named, restored = apart(docs, *quality.MEASURES.names, "quality", "base_failed", "kept")
    fitted = quality.posteriors(quality.measures(named, keep=[]))
    return restored(quality.judged(quality.measures(named), fitted).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    named, restored = apart(docs, *decontaminate.RESULT.names)
    marked = decontaminate.contamination(named, table(spark, sf_dir, "benchmark"))
    return restored(marked.where(F.size("items") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet the sources' target weights, in one global random order."""
    named, restored = apart(docs, "copy", "position")
    return restored(mixing.mix(named))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot and shard."""
    return sharding.place(docs, docs["doc_id"], sharding.shard_names(sharding.SHARDS), sharding.SLOTS)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: fingerprints, components and the fitted rules can't be written in SQL; tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
