from collections import Counter

import pytest
from fleetlens.llm import sharding
from nasty import documents


def test_table_is_full_even_and_stable():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 701)
    count = Counter(table)
    assert len(table) == 701 and set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup_table(names[:3] + names[4:], 701)
    number = [0, 1, 2, None, 3, 4, 5]
    moved = sum(a != 3 and number[a] != b for a, b in zip(table, fewer))
    assert moved < 0.25 * 701  # most slots of the other shards stay


@pytest.mark.parametrize("names,size", [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b", "c"], 2), (["a"], 2_000_003)])
def test_bad_tables_are_refused(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_every_row_is_placed_by_its_key(spark):
    docs = documents(spark)
    got = sharding.place(docs, docs["doc_id"], sharding.shard_names(5), 503)
    assert got.count() == docs.count()
    table = sharding.lookup_table(sharding.shard_names(5), 503)
    where = {}
    for r in got.collect():
        assert r["shard"] == table[r["slot"]]
        assert where.setdefault(r["doc_id"], r["slot"]) == r["slot"]
    assert len(set(where.values())) > 20
    assert {c.lower() for c in got.columns} == {c.lower() for c in docs.columns}
    assert sharding.place(docs.limit(0), docs["doc_id"], ["a"], 2).count() == 0


def test_no_shuffle_and_no_python(spark):
    docs = documents(spark)
    plan = sharding.place(docs, docs["doc_id"], sharding.shard_names(5), 503)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Python" not in plan and "BroadcastHashJoin" in plan
