import brute
from fleetlens.llm import queries, secrets
from nasty import documents, ordered, pairs


def spans(df):
    return ordered((r["doc_id"], [(f["kind"], f["start"], f["end"]) for f in r["found"]]) for r in df.collect())


def test_every_path_gets_the_findings_of_its_blob(spark):
    docs = documents(spark)
    got = secrets.report(docs, "text", secrets.scan(secrets.unseen(docs, "text", None))).collect()
    assert len(got) == docs.count()
    kinds = ("assign", "access", "hex")
    want = [r[:4] for r in brute.secrets(pairs(docs))]
    assert ordered((r["doc_id"], *[sum(f["kind"] == k for f in r["found"]) for k in kinds]) for r in got) == ordered(want)
    assert any(r[1] and r[2] and r[3] for r in want)
    none = docs.limit(0)
    assert secrets.report(none, "text", secrets.scan(secrets.unseen(none, "text", None))).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    docs = documents(spark)
    old, rules = docs.where("doc_id < 20"), secrets.RULES[:2]
    first = secrets.unseen(old, "text", None, rules)
    findings, ledger = secrets.scan(first, rules), secrets.seen_pairs(first)
    assert secrets.unseen(old, "text", ledger, rules).count() == 0
    later = secrets.unseen(docs, "text", ledger, rules)
    assert {r["blob"] for r in later.collect()} == {r["blob"] for r in secrets.unseen(docs, "text", None).collect()} - {r["blob"] for r in first.collect()}
    # a new rule: seen blobs are scanned for it alone
    more = secrets.unseen(docs, "text", ledger)
    assert {len(r["versions"]) for r in more.collect()} == {len(secrets.RULES) - 2, len(secrets.RULES)}
    both = findings.unionByName(secrets.scan(more))
    whole = secrets.scan(secrets.unseen(docs, "text", None))
    assert spans(secrets.report(docs, "text", both)) == spans(secrets.report(docs, "text", whole))


def test_runs_over_a_stored_ledger(spark, tmp_path):
    docs, folder, rules = documents(spark), str(tmp_path / "ledger"), secrets.RULES
    whole = spans(secrets.report(docs, "text", secrets.scan(secrets.unseen(docs, "text", None))))
    blobs = len({r["blob"] for r in secrets.unseen(docs, "text", None).collect()})
    none = docs.limit(0)
    assert secrets.advance(none, "text", folder).count() == 0
    first = secrets.advance(docs.where("doc_id < 20"), "text", folder, rules[:3]).count()
    assert 0 < first < blobs
    ledger = secrets.advance(docs, "text", folder)
    # the blobs of the first run again, for the other rules, and each other blob once
    assert sorted(len(r["versions"]) for r in ledger.collect()) == sorted([3] * first + [len(rules) - 3] * first + [len(rules)] * (blobs - first))
    assert spans(secrets.report(docs, "text", secrets.findings(ledger))) == whole
    assert secrets.advance(docs, "text", folder).count() == first + blobs
    # what two runs add alike counts once; a rule that is not in use any more gives no findings
    assert spans(secrets.report(docs, "text", secrets.findings(ledger.union(ledger)))) == whole
    base = secrets.report(docs, "text", secrets.findings(ledger, rules[:3])).collect()
    assert {f["kind"] for r in base for f in r["found"]} <= {"assign", "access", "hex"}


def test_own_kinds(spark):
    key = "x ghp_" + "a1B2" * 9 + " y\n-----BEGIN RSA PRIVATE KEY-----\nAIza" + "k" * 35 + " postgres://user:pass@host xoxb-1234567890ab"
    docs = spark.createDataFrame([(1, key)], "doc_id bigint, text string")
    found = secrets.report(docs, "text", secrets.scan(secrets.unseen(docs, "text", None))).first()["found"]
    assert [f["kind"] for f in found] == ["github", "private_key", "google", "url_login", "slack"]


def test_long_tokens_are_found_whole(spark):
    long = "A1b-" * 2_000
    tokens = [f"eyJ{long}.eyJ{long}.{long}", "xoxb-" + "1a2b" * 100, "ghp_" + "a1B2" * 100, "sk_live_" + "a1B2" * 100, "scheme://" + "u" * 500 + ":" + "p" * 500 + "@"]
    docs = spark.createDataFrame([(1, " ".join(tokens))], "doc_id bigint, text string")
    found = secrets.report(docs, "text", secrets.scan(secrets.unseen(docs, "text", None))).first()["found"]
    text = " ".join(tokens)
    assert [text[f["start"]:f["end"]] for f in found if f["kind"] in ("jwt", "slack", "github", "stripe", "url_login")] == tokens


def test_registered_query(spark, sf):
    got = queries.op6_secrets(spark, sf.dir).collect()
    assert ordered(tuple(r)[:5] for r in got) == ordered(brute.secrets(sf("documents", "doc_id", "text")))
