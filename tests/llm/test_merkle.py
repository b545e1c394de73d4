import hashlib
import zlib

import brute
import pytest
from fleetlens.llm import merkle, queries
from nasty import documents, ordered
from pyspark.sql import functions as F


def manifest(df, order="doc_id", group="lang", keep=("doc_id", "claimed")):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = df.withColumns({"leaf": merkle.leaf(*fields, F.col("text")), "claimed": merkle.leaf(*fields, brute_tampered())})
    return merkle.build(leaves, group, [order], "leaf", list(keep))


def brute_tampered():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", brute.UPPER, brute.UPPER.lower())).otherwise(F.col("text"))


@pytest.mark.parametrize("sizes", [[1], [8], [9], [64], [65], [1, 8, 9], [700, 3, 1, 64], [1] * 9, [2] * 70])
def test_shapes_of_trees(spark, sizes):
    rows = [(i, f"Text {g} {i}", None if g == 0 else f"l{g}", "s", None) for g, n in enumerate(sizes) for i in range(g * 1000, g * 1000 + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.climb(manifest(docs), "claimed", ["doc_id"])
    want = brute.merkle([(i, s, g, n, t) for i, t, g, s, n in rows])
    sha = F.sha2(F.col("siblings").cast("binary"), 256)
    rows = got.select("doc_id", "leaf", "subroot", "root", sha, "folded", F.col("folded") == F.col("root")).collect()
    assert ordered(map(tuple, rows)) == ordered(want)


def test_nulls_clashes_and_equal_rows(spark):
    docs = documents(spark)
    m = manifest(docs, keep=("doc_id", "claimed", "position", "copy", "fingerprint"))
    got = merkle.climb(m, "claimed", ["doc_id", "position", "copy"])
    assert got.columns == ["doc_id", "position", "copy", "leaf", "subroot", "root", "siblings", "folded"]
    want = brute.merkle([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    sha = F.sha2(F.col("siblings").cast("binary"), 256)
    rows = got.select("doc_id", "leaf", "subroot", "root", sha, "folded", F.col("folded") == F.col("root")).collect()
    assert ordered(map(tuple, rows)) == ordered(want) and {r[-1] for r in want} == {True, False}
    none = manifest(docs.limit(0))
    assert none.root is None and merkle.climb(none, "claimed", ["doc_id"]).count() == 0


def test_names_like_the_own_ones(spark):
    odd = spark.createDataFrame([(i, f"x{i}", "g", "p", 1, 2, 3) for i in range(20)], ["a.b", "hash", "grp", "pos", "n", "run", "siblings"])
    m = merkle.build(odd, "grp", ["a.b"], "hash", ["a.b", "hash", "pos", "n", "run", "siblings"])
    got = merkle.climb(m, "hash", ["a.b", "pos", "n", "run", "siblings"])
    assert got.columns == ["a.b", "pos", "n", "run", "leaf", "subroot", "root", "siblings", "folded"]
    rows = got.collect()
    assert len(rows) == 20 and all(r["folded"] == r["root"] == m.root for r in rows)
    level = [hashlib.sha256("".join(f"x{i}" for i in range(a, min(a + 8, 20))).encode()).hexdigest() for a in (0, 8, 16)]
    assert m.root == hashlib.sha256("".join(level).encode()).hexdigest()


def test_registered_query(spark, sf):
    got = queries.op12_merkle(spark, sf.dir).collect()
    want = brute.merkle(sf("documents", "doc_id", "source", "lang", "n_chars", "text"))
    assert ordered(map(tuple, got)) == ordered(want)
    assert {r[0] for r in want if not r[-1]} <= {r[0] for r in want if zlib.crc32(str(r[0]).encode()) % 3 == 0}
