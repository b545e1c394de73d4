import random

import brute
import pytest
from fleetlens.llm import queries, simhash
from fleetlens.llm.components import components
from nasty import documents, ordered, pairs


def shown(rows):
    return [(r["doc_id"], f"{r['fingerprint'] & (1 << 64) - 1:016x}", r["component_id"]) for r in rows]


def test_equals_brute_force(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs)
    assert ordered(shown(got.collect())) == ordered(brute.simhash(pairs(docs)))


def test_one_of_each_keeps_the_smallest_id_of_each_component(spark):
    docs = documents(spark).where("text IS NULL OR text <> 'another text of id three'")  # the id of another component, too
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    first = {}
    for (i, text), (_, _, component) in zip(pairs(docs), brute.simhash(pairs(docs))):
        first.setdefault(component, set()).add((i, text))
    kept = pairs(got)
    assert len(kept) == len(first) and {c for c in first} == {i for i, _ in kept}
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits,segments", [(4, 3), (4, 2), (3, 4), (5, 2), (0, 3)])
def test_links_are_complete(spark, bits, segments):
    r = random.Random(bits)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(6):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, bits + 3))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint"), bits, segments).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= bits}


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    got |= {r: r for r in got.values()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 260)}, **{i: 300 for i in range(300, 320)}}


def test_registered_query(spark, sf):
    docs = sf("documents", "doc_id", "text")
    assert ordered(map(tuple, queries.op3_simhash(spark, sf.dir).collect())) == ordered(brute.simhash(docs))
