import brute
from fleetlens.llm import decontaminate, queries
from nasty import documents, ordered, pairs

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (2, "short item"), (10, "tie tie tie"),
         (None, "Beta"), (3, None), (4, ""), (5, "!!"), (6, "one two three four five six seven eight nine ten"), (7, "shared1 " * 4 + " ".join(f"shared{i}" for i in range(40)))]


def digest(rows):
    import hashlib
    return [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]),
             hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in rows]


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs = documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = ordered(brute.contamination(pairs(docs), ITEMS))
    whole = decontaminate.contamination(docs, items)
    assert set(docs.columns) <= set(whole.columns)
    assert ordered(digest(whole.collect())) == want
    few = list(decontaminate.blocks(items, "item_id", "text", block_words=80))
    assert len(few) > decontaminate.CHAIN  # also goes through a checkpoint
    assert ordered(digest(decontaminate.contamination(docs, items, block_words=80).collect())) == want


def test_random_texts_with_few_words(spark):
    import random
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 60)))) for i in range(200)]
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 30)))) for i in range(20)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert ordered(digest(got.collect())) == ordered(brute.contamination(docs, items))


def test_many_copies_and_items_without_an_id(spark):
    def text(name):
        return " ".join(f"{name}w{i}" for i in range(30))

    items = [(1, text("copy"))] * 200 + [(None, text(f"n{i}")) for i in range(100)] + [(i, text("equal")) for i in range(2, 60)]
    docs = [(1, "a " + text("copy") + " b"), (2, text("n7") + " " + text("n93")), (3, text("equal")), (4, "none")]
    rows = spark.createDataFrame(items, "item_id bigint, text string")
    parts = [b for b, _ in decontaminate.blocks(rows, "item_id", "text", block_words=1500)]
    assert len(parts) > 1 and max(len(p.word) for p in parts) <= 1500
    assert sum(len(p.word) for p, _ in decontaminate.blocks(rows.where("item_id = 1"), "item_id", "text", block_words=1500)) == 30
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), rows, block_words=1500)
    assert ordered(digest(got.collect())) == ordered(brute.contamination(docs, items))


def test_equal_words_over_and_over():
    import resource
    import time
    texts = ["same " * 100_000, "a b " * 20_000 + "c", "same " * 9, "x " + "same " * 10 + "y"]
    items = [("one", "same " * 10_000), ("two", "b a " * 3_000), ("three", "same " * 8 + "z"), ("four", "same " * 500)]
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    block = decontaminate.Block(items)
    for g in decontaminate.groups(decontaminate.pa.array(texts), decontaminate.ALNUM, True):
        hit, pairs = block.matches(g.hash, g.doc)
    assert time.time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert [(int(d), block.names[i]) for d, i in pairs] == [(0, "four"), (0, "one"), (1, "two"), (3, "four"), (3, "one")]
    assert [int(hit[g.doc == d].sum()) for d in range(4)] == [100_000, 40_000, 0, 10]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark)
    assert not any(r["items"] or r["spans"] for r in decontaminate.contamination(docs, none).collect())
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_registered_query(spark, sf):
    docs, items = sf("documents", "doc_id", "text"), sf("benchmark", "item_id", "text")
    assert ordered(map(tuple, queries.op1_decontaminate(spark, sf.dir).collect())) == ordered(brute.contamination(docs, items))
