import random

import numpy as np
import pytest
from graphs_by_hand import M1, M1_STEPS, M2, M2_STEPS, kruskal, naive_staircase, random_graph, window

from sylva.operators.forest import spanning_mask
from sylva.operators.staircase import scan
from sylva.streaming.dynamic import INVALID, REPLACED, STRUCTURAL, UNCHANGED, DynamicForest
from sylva.streaming.sliding import Alive


def array(edges):
    return np.array(edges, np.int64).reshape(-1, 4)


def steps(edges, total, length):
    """The staircase by independent blocks, from local forests."""
    local = array([e for t in range(total) for e in window(edges, t, t)])
    out = {}
    for first in range(0, total, length):
        last = min(total, first + length) - 1
        for te, live, s in scan(local[local[:, 3] <= last], first, last):
            for e, v in zip(map(tuple, live.tolist()), s.tolist(), strict=True):
                had = out.setdefault(e, [])
                assert not had or v >= had[-1][0]
                if not had or v > had[-1][0]:
                    had.append((v, te))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_forest_and_staircase_on_random_graphs(seed):
    n, total, edges = random_graph(seed)
    rows = array(edges)
    assert set(map(tuple, rows[spanning_mask(np.zeros(len(rows), int), *rows.T)].tolist())) == set(kruskal(edges))
    assert steps(edges, total, 1 + seed % 4) == naive_staircase(edges, total)


def test_forests_of_several_keys_are_apart():
    key = np.array([r[3] for r in M1])
    found = array(M1)[spanning_mask(key, *array(M1).T)]
    assert set(map(tuple, found.tolist())) == {e for t in range(4) for e in window(M1, t, t)}


def test_staircases_by_hand():
    assert steps(M1, 4, 2) == M1_STEPS
    assert steps(M2, 3, 1) == M2_STEPS


def test_alive_rows_that_are_not_in_todays_forest_must_stay():
    state = Alive()
    state.advance(0, array([(0, 1, 1, 0)]), 2)
    state.advance(1, array([(0, 1, 9, 1)]), 2)
    state.advance(2, array([]), 2)
    assert state.forest(0).tolist() == [[0, 1, 1, 0]]
    state.advance(3, array([]), 2)
    assert state.forest(1).tolist() == [[0, 1, 9, 1]]


@pytest.mark.parametrize("seed", range(40))
def test_dynamic_forest_under_random_operations(seed):
    r = random.Random(seed)
    n, _, edges = random_graph(1000 + seed)
    forest, there = DynamicForest(n), set()
    for _ in range(120):
        if there and r.random() < 0.4:
            e = r.choice(sorted(there))
            before = set(kruskal(there))
            code, other = forest.delete(e)
            there.discard(e)
            after = set(kruskal(there))
            assert code == (UNCHANGED if before == after else STRUCTURAL if len(after) < len(before) else REPLACED)
            assert (other is None) == (code != REPLACED)
        elif edges:
            e = r.choice(edges)
            before = set(kruskal(there))
            code, other = forest.insert(e)
            if e in there or e[0] == e[1]:
                assert code == INVALID
                continue
            there.add(e)
            after = set(kruskal(there))
            assert code == (UNCHANGED if before == after else STRUCTURAL if len(after) > len(before) else REPLACED)
            assert other == (next(iter(before - after)) if code == REPLACED else None)
        assert set(forest.forest()) == set(kruskal(there))
        assert forest.components() == n - len(kruskal(there))


@pytest.mark.parametrize("seed", range(10))
def test_forest_of_a_graph_at_hand(seed):
    r = random.Random(seed)
    n, _, edges = random_graph(2000 + seed)
    forest = DynamicForest.of(n, [*edges, *edges[:3]])
    assert set(forest.forest()) == set(kruskal(edges)) and str(forest).count("\n") == max(0, len(kruskal(edges)) - 1)
    there = {e for e in edges if e[0] != e[1]}
    assert forest.edges == there
    for e in r.sample(sorted(there), len(there) // 2):
        forest.delete(e)
        there.discard(e)
        assert set(forest.forest()) == set(kruskal(there))


def test_deletions_look_at_few_edges():
    """A heavy edge's replacement search stops at the first edges that are no better, however many there are."""
    n, r = 60, random.Random(1)
    edges = sorted({(a, b, r.randrange(10**6), t) for t in range(100) for a, b in [r.sample(range(n), 2) for _ in range(200)]})
    forest = DynamicForest.of(n, edges)
    for e in forest.forest()[:30]:
        forest.delete(e)
    assert forest.work["looked at"] < len(edges) / 10 and forest.work["deleted"] == 30


def test_ordered_edges_are_not_sorted():
    _, _, edges = random_graph(3)
    rows = array(sorted(edges, key=lambda e: (e[2], -e[3], e[0], e[1])))
    zero = np.zeros(len(rows), int)
    assert (spanning_mask(zero, *rows.T, ordered=True) == spanning_mask(zero, *rows.T)).all()


def test_codes_of_edges_that_do_not_fit():
    forest = DynamicForest(2)
    assert forest.insert((0, 0, 1, 0))[0] == INVALID
    assert forest.insert((0, 5, 1, 0))[0] == INVALID
    assert forest.delete((0, 1, 1, 0))[0] == INVALID
    assert forest.insert((0, 1, 1, 0))[0] == STRUCTURAL and forest.is_below(1, 0, 0) and not forest.is_below(0, 1, 0)
