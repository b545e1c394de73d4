import random
import re
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from fleetlens.llm import collocations, queries
from nasty import documents, ordered


def corpus(seed=3, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "a b", "x-y", "it's"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["new york city", "w0 w0 w0 w0", "machine learning model of w1 w2"]
    out = []
    for i in range(n):
        text = []
        for _ in range(r.randrange(0, 60)):
            text.append(r.choice(fixed) if r.random() < .1 else r.choices(words, weights)[0])
            text.append(r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!?", " \r\n"]))
        out.append((i, "".join(text).upper() if i % 7 == 0 else "".join(text), ["en", "en", "de", None, "und"][i % 5]))
    return out + [(1000, None, "en"), (1001, "", None), (1002, " .,;\n ", "fr")]


@pytest.mark.parametrize("least,top,words,phrases", [(5, 2000, 1 << 20, 1 << 20), (5, 7, 10, 25), (2, 50, 1 << 20, 300), (100, 2000, 1 << 20, 1 << 20)])
def test_equals_brute_force(spark, least, top, words, phrases):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = collocations.mine(docs, least=least, top=top, max_words=words, max_phrases=phrases).collect()
    want = brute.collocations([(t, g) for _, t, g in rows], least=least, top=top)
    assert ordered(map(tuple, got)) == ordered(want) and len(want) > 5


def test_groups_far_into_a_batch():
    r = random.Random(5)
    texts = ["".join(r.choice(["Ab", "é", "ß ", " ", "X.", "\n", "日"]) for _ in range(2000)) for _ in range(9000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    seen = 0
    for words, lang, piece, row, first, last in collocations._tokens(batch):
        want = [(i, w) for i, t in enumerate(texts[first:last]) for p in re.split(r"[.\n]", brute.lower(t)) for w in p.split(" ") if w]
        assert list(zip(row.tolist(), words.to_pylist())) == want and first == seen
        seen = last
    assert seen == len(texts) and batch.nbytes > 5 * collocations.GROUP


def test_words_of_odd_texts():
    r = random.Random(6)
    marks = ["a", "B", "é", "日", "\x85", "\xa0", "\x00", "\x1f", "-", " ", "\t", ".", ",", ";", ":", "!", "?", "\n", "\x0b", "\x0c", "\r"]
    for _ in range(300):
        texts = [None if r.random() < .1 else "".join(r.choices(marks, k=r.choice([0, 1, 2, 40]))) for _ in range(r.randrange(0, 9))]
        langs = [r.choice(["en", None, "de"]) for _ in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(["xx", *langs], pa.string()), pa.array([".x", *texts], pa.string())], names=["lang", "text"]).slice(1)
        want = [(w, g or "und", i, p) for i, (t, g) in enumerate(zip(texts, langs)) for p, x in enumerate(re.split(r"[.,;:!?\n\x0b\x0c\r]+", brute.lower(t or "")))
                for w in re.split(r"[ \t]+", x) if w]
        got = [x for words, lang, piece, row, _, _ in collocations._tokens(batch) for x in zip(words.to_pylist(), lang.to_pylist(), row.tolist(), piece.tolist())]
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert [a[3] != b[3] for a, b in zip(got, got[1:])] == [a[2:] != b[2:] for a, b in zip(want, want[1:])]


def test_nothing_frequent_and_nothing_at_all(spark):
    docs = documents(spark)
    assert ordered(map(tuple, collocations.mine(docs, least=20).collect())) == \
        ordered(brute.collocations([(r["text"], r["lang"]) for r in docs.collect()], least=20))
    assert collocations.mine(docs, least=10 ** 9).count() == 0
    none = collocations.mine(docs.limit(0))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    every = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, words int, a long")
    words = spark.createDataFrame([("en", w, big + i, 900 * big) for i, w in enumerate("ab")], "lang string, word string, n long, all long")
    from unittest import mock
    with mock.patch.object(collocations, "phrases", lambda *a: (every, words)):
        r = collocations.mine(None).first()
    assert (r["score"], r["l"], r["r"]) == (1000 * big * 900 * big // (big * (big + 1)), big, big + 1)


@pytest.mark.parametrize("most", [5, 900, 3000, 2 ** 21])
def test_double_array_holds_what_was_put_in(most):
    r = random.Random(most)
    seqs = {tuple(r.randrange(1, most + 1) if r.random() < .5 else r.randrange(1, min(most, 12) + 1) for _ in range(r.randrange(1, 5))) for _ in range(6000)}
    seqs |= {(1, i) for i in range(1, min(most, 2500))}
    seqs = sorted(seqs)
    trie = collocations.DoubleArray([np.array(x, np.int32) for x in seqs], most)
    text = np.array([0] + [x for s in r.sample(seqs, min(len(seqs), 2000)) for x in (*s, 0)] + [r.randrange(0, min(most, 14) + 1) for _ in range(3000)] + [0], np.int32)
    got = {}
    for k, place, state in trie.walk(text):
        for p, a in zip(place, trie.accepts[state]):
            if a >= 0:
                got[int(p), k] = seqs[a]
    number = set(seqs)
    want = {(i, k): tuple(text[i:i + k].tolist()) for i in range(len(text)) for k in range(1, 5) if tuple(text[i:i + k].tolist()) in number and i + k <= len(text)}
    assert got == want
    assert sum(trie.accepts >= 0) == len(seqs)


def test_double_array_grows_with_its_phrases():
    """Many phrases over many words, most of them rare: slots and time in proportion to the nodes."""
    r, most = np.random.default_rng(8), 60_000
    number = r.permutation(most).astype(np.int32) + 1
    seqs = np.unique(number[np.minimum(most ** r.random((120_000, 3)), most).astype(int) - 1], axis=0)
    seqs = r.permutation(seqs)
    began = time.process_time()
    trie = collocations.DoubleArray(list(seqs), most)
    assert time.process_time() - began < 15
    nodes = sum(len(np.unique(x)) for x in (seqs[:, 0] >> collocations.BITS, seqs[:, 0]))
    for k in (1, 2):
        rows = np.unique(np.column_stack([seqs[:, :k], seqs[:, k] >> collocations.BITS]), axis=0)
        nodes += len(rows) + len(np.unique(seqs[:, :k + 1], axis=0))
    assert (trie.check >= 0).sum() == nodes and len(trie.base) < 2 * nodes
    text = np.append(np.insert(seqs, 0, 0, axis=1).ravel(), 0).astype(np.int32)
    place, state = next((p, s) for k, p, s in trie.walk(text) if k == 3)
    whole = place % 4 == 1
    assert trie.accepts[state[whole]].tolist() == list(range(len(seqs))) and not whole[trie.accepts[state] < 0].any()


@pytest.mark.parametrize("sizes", [[1], [1024] * 40, [1] * 500 + [2] * 500, list(range(1, 300)) * 3, [64, 63, 65, 1024, 1023, 1, 1] * 30])
def test_children_get_slots_of_their_own(sizes):
    r = np.random.default_rng(len(sizes))
    families = [np.sort(r.choice(collocations.WIDTH, n, replace=False)) for n in sizes]
    begin = np.cumsum([0, *sizes[:-1]])
    first = collocations._placed(np.concatenate(families), begin)
    slots = np.concatenate([f + x - x[0] for f, x in zip(first, families)])
    assert len(np.unique(slots)) == len(slots) and slots.min() >= collocations.WIDTH
    assert all(f - x[0] > 0 for f, x in zip(first, families))


def test_registered_query(spark, sf):
    want = brute.collocations(sf("documents", "text", "lang"))
    assert ordered(map(tuple, queries.op13_collocations(spark, sf.dir).collect())) == ordered(want)
