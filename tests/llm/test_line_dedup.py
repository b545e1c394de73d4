import brute
from fleetlens.llm import line_dedup, queries
from nasty import documents, ordered, pairs


def test_equals_brute_force(spark):
    docs = documents(spark, clash=False).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = line_dedup.drop_repeats(docs).collect()
    want = brute.line_dedup(sorted(pairs(docs)))
    assert ordered((r["doc_id"], r["text"]) for r in got) == ordered(want)
    whole = dict(pairs(docs))
    for r in got:  # offsets lead back to the original
        assert r["text"] is None or "\n".join(whole[r["doc_id"]][s["start"]:s["end"]] for s in r["kept"]) == r["text"]
    assert any(r["n_removed"] for r in got)


def test_passages_inside_lines(spark):
    passage = " ".join(f"Word{i} and word{i} again number {i}." for i in range(10))  # 60 words, 10 sentences
    rows = [(1, f"An opening of its own. {passage} An end of its own."), (2, f"Another opening! {passage} Another end?\nA line more."),
            (3, f"{passage[:passage.index('Word4')]}stays as it is short."), (4, f"Head.\nJoined {passage}\nTail.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeats(docs, sentences=True).collect()}
    assert [got[i]["text"] for i in (1, 3)] == [rows[0][1], rows[2][1]]
    assert got[2]["text"] == "Another opening!\nAnother end?\nA line more." and got[2]["n_removed"] == 60
    assert got[4]["text"] == "Head.\nJoined Word0 and word0 again number 0.\nTail." and got[4]["n_removed"] == 54
    for i, text in rows:
        assert "\n".join(text[s["start"]:s["end"]] for s in got[i]["kept"]) == got[i]["text"]


def test_registered_passages_hold_the_lines_found(spark, sf):
    rows = sorted(sf("documents", "doc_id", "text"))
    whole = dict(rows)
    lines = {i: len((whole[i] or "").split()) - len((t or "").split()) for i, t in brute.line_dedup(rows)}
    got = queries.op9_passage_dedup(spark, sf.dir).collect()
    assert ordered((r["doc_id"], r["text"]) for r in got) == ordered(brute.line_dedup(rows, sentences=True))
    assert all(r["n_removed"] >= lines[r["doc_id"]] for r in got) and sum(r["n_removed"] for r in got) > sum(lines.values())
    assert all("\n".join(whole[r["doc_id"]][s["start"]:s["end"]] for s in r["kept"]) == r["text"] for r in got)


def test_passage_joined_to_other_text_at_both_ends(spark):
    words = [f"word{i}" for i in range(64)]
    sentences = [" ".join(words[i:i + 8]) + "." for i in range(0, 64, 8)]
    inner = " ".join(sentences)[:-1]  # the last sentence goes on
    rows = [(1, "A first text says that " + inner + " and so it ends."), (2, "Quite another one " + inner + " but goes on. And on."), (3, "Only this: " + sentences[2] + " No more.")]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=line_dedup.PASSAGE_WORDS, sentences=True).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 48, 0] and got[3]["text"] == rows[2][1]


def test_nulls_clashes_and_equal_rows(spark):
    docs = documents(spark)
    got = line_dedup.drop_repeats(docs, min_words=1)
    assert got.count() == docs.count()
    lines = [" ".join(x.casefold().split()) for _, t in pairs(got) for x in (t or "").split("\n")]
    lines = [x for x in lines if x]
    assert len(lines) == len(set(lines))  # nothing stands twice, whatever repeats
    assert set(lines) == {" ".join(x.casefold().split()) for _, t in pairs(docs) for x in (t or "").split("\n")} - {""}
    assert line_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_registered_query(spark, sf):
    got = queries.op9_line_dedup(spark, sf.dir).collect()
    assert ordered((r["doc_id"], r["text"]) for r in got) == ordered(brute.line_dedup(sorted(sf("documents", "doc_id", "text")), 30, sentences=True))
