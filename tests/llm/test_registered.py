"""Queries with SQL equal it; the pipeline equals a brute-force version; native operators run no Python."""

import brute
import check
import corpus_pipeline
import pytest
from fleetlens.llm import mixing, queries, sharding
from fleetlens.llm.oracle import LLM_ORACLE
from nasty import documents, ordered
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    r = check.compare(spark, check.duck(sf.dir), name, queries.LLM_QUERIES[name], LLM_ORACLE[name], sf.dir)
    assert r["match"], r


@pytest.mark.parametrize("name", ["op5_licenses", "op6_secrets", "op8_place_shards"])
def test_native_plans(spark, sf, name):
    plan = queries.LLM_QUERIES[name](spark, sf.dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline_equals_brute_force(spark, sf):
    docs = sf("documents", "doc_id", "text", "source")
    rows = {r[0]: r for r in docs}
    kept = {r["doc_id"] for r in queries.op10_quality(spark, sf.dir).collect() if r["kept"]}
    left = [(i, t) for i, t, _ in docs if i in kept]
    left = [(i, t) for (i, t), (_, _, c) in zip(left, brute.simhash(left)) if i == c]
    left = [(i, t) for (i, t), r in zip(left, brute.contamination(left, sf("benchmark", "item_id", "text"))) if not r[5]]
    df = spark.createDataFrame([(i, rows[i][2]) for i, _ in left], "doc_id bigint, source string")
    names = sharding.shard_names(sharding.SHARDS)
    mixed = mixing.mix(df)
    want = sharding.place(mixed, mixed["doc_id"], names, sharding.SLOTS).select("doc_id", "slot", "shard").collect()
    got = corpus_pipeline.run(spark, sf.dir)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    got = got.collect()
    assert ordered(tuple(r) for r in want) == ordered((r["doc_id"], r["slot"], r["shard"]) for r in got)
    assert all(r["text"] == rows[r["doc_id"]][1] for r in got) and len(got) > 100


def test_stages_stand_everything(spark, sf):
    for docs in (documents(spark), documents(spark).limit(0)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf.dir)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            out.write.format("noop").mode("overwrite").save()
            assert out.where(F.col("text").isNull()).count() >= 0
