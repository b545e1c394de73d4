import random

from fleetlens.llm import queries, warc
from nasty import ordered
from pyspark.sql import functions as F

SCHEMA = "record_id bigint, url string, ts bigint, status int, headers array<struct<name:string,value:string>>, body string, outcome string, x int"


def brute(rows):
    out = []
    tag = lambda h: next((v for n, v in h or [] if n and n.lower() == "etag"), None)
    for r in rows:
        if r[3] != 304:
            continue
        old = [o for o in rows if o[3] == 200 and o[1] is not None and o[1] == r[1] and (o[2] if o[2] is not None else -1) < (r[2] if r[2] is not None else -1)]
        if not old:
            out.append((r[0], "no_earlier", 304, None))
            continue
        top = max(o[2] if o[2] is not None else -1 for o in old)
        ends = [o for o in old if (o[2] if o[2] is not None else -1) == top]
        assert len({repr(o) for o in ends}) == 1
        ok = tag(r[4]) is None or tag(r[4]).removeprefix("W/") == (tag(ends[0][4]) or "").removeprefix("W/")
        out.append((r[0], "resolved" if ok else "mismatch", 200 if ok else 304, ends[0][5] if ok else None))
    return out


def test_random_records_with_a_hot_url(spark):
    r = random.Random(5)
    rows, used = [], set()
    for i in range(1500):
        url = r.choice(["h/hot"] * 5 + [f"h/{r.randrange(40)}", None])
        ts = r.choice([None, r.randrange(500)]) if r.random() < 0.1 else r.randrange(500)
        full = r.random() < 0.2
        if full and (url, ts) in used:
            continue  # one response of a time, so that the latest is known
        used |= {(url, ts)} if full else set()
        head = [("ETag", f'"{r.randrange(2)}"')] if r.random() < 0.8 else None
        rows.append((i, url, ts, 200 if full else 304, head, f"body{i}" if full else None, "old", i))
    rows += [rows[10], next(x for x in rows if x[3] == 304), next(x for x in rows if x[3] == 200)]
    records = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 7, 40):
        got = warc.resolve(records, partitions=n)
        assert ordered((x["record_id"], x["outcome"], x["status"], x["body"]) for x in got.collect()) == ordered(brute(rows))
    assert {c.lower() for c in got.columns} == {c.lower() for c in records.columns} | {"refers_to"}
    assert warc.resolve(records.limit(0)).count() == 0


def test_canonical_urls(spark):
    same = ["http://www.Host.com/a?b=1&a=2", "https://host.com:443/a/?a=2&b=1#frag", "HTTP://user@www2.host.com:80/a?a=2&&b=1&utm_source=x", " host.com/a?b=1&a=2&fbclid=z "]
    other = ["http://host.com:8080/a?a=2&b=1", "http://host.com/A?a=2&b=1", "http://host.com/a", None, ""]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(warc.canonical(F.col("u")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert set(got[:4]) == {"host.com/a?a=2&b=1"} and len(set(got)) == 6 and got[7] is None


def test_headers_are_merged_by_the_rules(spark):
    stored = [("Content-Type", "text/html"), ("Content-Length", "9"), ("ETag", '"a"'), ("Cache-Control", "max-age=1"), (None, "no name")]
    fresh = [("etag", 'W/"a"'), ("content-length", "0"), ("cache-control", "max-age=2"), ("Set-Cookie", "k=1"), ("Connection", "close")]
    rows = [(1, "u/", 1, 200, stored, "B", None, 0), (2, "u", 2, 304, fresh, None, None, 0), (3, "u", 3, 304, [("Last-Modified", "x")], None, None, 0)]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(h) for h in got[2]["headers"]] == [("Content-Type", "text/html"), ("Content-Length", "9"), ("etag", 'W/"a"'), ("cache-control", "max-age=2"), ("Set-Cookie", "k=1")]
    assert (got[2]["refers_to"], got[2]["body"], got[3]["outcome"], got[3]["refers_to"]) == (1, "B", "mismatch", None)


def test_the_registered_captures_exercise_the_choice(spark, sf):
    got = queries.op7_revisits(spark, sf.dir).collect()
    seen = {(r["record_id"] % 6, r["outcome"], None if r["refers_to"] is None else r["refers_to"] % 6) for r in got}
    assert seen >= {(1, "resolved", 0), (1, "no_earlier", None), (2, "resolved", 0), (2, "resolved", 3), (2, "mismatch", None),
                    (4, "resolved", 4), (4, "mismatch", None), (5, "resolved", 4)}
    hot = sum(r["record_id"] % 6 > 3 for r in got)
    assert hot > len(got) / 3
