import brute
from fleetlens.llm import quality, queries
from fleetlens.llm.frames import apart
from nasty import documents, ordered, pairs

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_equal_brute_force(spark):
    docs = documents(spark)
    measured = quality.measures(docs)
    got = quality.judged(measured, quality.posteriors(measured))
    assert ordered(tuple(r[c] for c in BASE) for r in got.collect()) == ordered(brute.quality(pairs(docs)))
    none = quality.measures(docs.limit(0))
    assert quality.judged(none, quality.posteriors(none)).count() == 0
    named, restored = apart(docs, *quality.MEASURES.names)
    assert restored(quality.measures(named)).columns == docs.columns


def test_estimates_tell_a_noisy_rule_from_a_sure_one(spark):
    at = {n: i for i, n in enumerate(quality.RULES)}

    def pattern(*names):
        return [(1 if at[n] < quality.GOOD_RULES else 2) if n in names else 0 for n in quality.RULES]

    good, rate = quality.fit([(pattern("prose", "varied"), 9000), (pattern("varied", "symbols"), 300), (pattern("prose", "repeats", "top_word"), 300),
                              (pattern("prose"), 40), (pattern("varied", "capitals", "marks"), 100)])
    assert [bool(g > quality.THRESHOLD) for g in good] == [True, False, False, False, False] or [bool(g > quality.THRESHOLD) for g in good] == [True, False, False, True, False]
    assert rate["good"][at["symbols"]] < rate["bad"][at["symbols"]]


def test_labelled_documents(spark, sf):
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, "/root/testdata/sf0.01").collect()}
    sf.dir, before = "/root/testdata/sf0.01", sf.dir
    labels = sf("labels", "doc_id", "quality")
    sf.dir = before
    clean = [got[i]["kept"] for i, q in labels if q == 1 and not got[i]["base_failed"]]
    junk = [got[i]["kept"] for i, q in labels if q == 0]
    assert sum(clean) == len(clean) and sum(junk) <= 0.1 * len(junk)
