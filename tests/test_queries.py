import random

import pytest
from graphs_by_hand import kruskal

import __spark_entry__ as entry_module
from sylva import queries
from sylva.streaming import dynamic

LIGHT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    oracle(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_dynamic_codes_are_those_of_every_operation(spark):
    n = queries.graphs.trade(spark, LIGHT).count()
    codes = {(r.op, r.code): r.n for r in queries.dynamic_codes(spark, LIGHT).collect()}
    assert sum(k for (op, _), k in codes.items() if op == "insert") == n
    assert all(code >= 0 for _, code in codes) and codes["insert", dynamic.UNCHANGED] > 0 and codes["delete", dynamic.UNCHANGED] > 0


def test_only_dynamic_codes_have_no_sql():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"dynamic_codes"}


def test_stream_codes_against_a_plain_replay(spark):
    r = random.Random(4)
    edges = sorted({(a, b, r.randrange(30), t) for t in range(9) for _ in range(14) for a, b in [r.sample(range(7), 2)]})
    operations = dynamic.sliding_operations(queries._stream(spark.createDataFrame(edges, "src int, dest int, weight int, ts int")), 4)
    expected, live, before = {}, {0: set(), 1: set()}, {0: set(), 1: set()}
    for x in sorted(operations.collect(), key=lambda x: (x.graph_id, x.seq)):
        e, g = (x.src, x.dest, x.weight, x.ts), x.graph_id
        (live[g].add if x.op == "insert" else live[g].remove)(e)
        after = set(kruskal(live[g]))
        same, size = after == before[g], len(after) == len(before[g])
        expected[g, x.seq] = dynamic.UNCHANGED if same else dynamic.REPLACED if size else dynamic.STRUCTURAL
        before[g] = after
    assert {(x.graph_id, x.seq): x.code for x in dynamic.replay(operations, 7).collect()} == expected
    assert set(expected.values()) == {dynamic.UNCHANGED, dynamic.REPLACED, dynamic.STRUCTURAL}


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["dynamic_codes", "dynamic_forest_by_quarter"])
def test_the_replay_in_one_task_gets_a_part_of_the_stream(spark, monkeypatch, name):
    plain, counts = dynamic.replay, []
    monkeypatch.setattr(dynamic, "replay", lambda operations, n: counts.append(operations.count()) or plain(operations, n))
    queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert counts and max(counts) < queries.graphs.trade(spark, "/root/testdata/sf0.01").count() / 3
