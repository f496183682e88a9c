"""Chains in order, paths and diameters: the same by joins as over a graph held in one place, and how many searches they take."""

import numpy as np
import pandas as pd
import pytest

from crestline.operators import dense, graph
from crestline.operators import filaments as fil
from crestline.operators.state import limited

rnd = np.random.default_rng(4)


def graph_of(spark, pairs, n):
    nodes = spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "x": rnd.random(n), "y": rnd.random(n)})).cache()
    nodes.count()
    return nodes, spark.createDataFrame(pd.DataFrame(np.asarray(pairs, dtype=np.int64).reshape(-1, 2), columns=["src", "dst"]))


TREE = [(i, int(rnd.integers(max(0, i - 3), i))) for i in range(1, 80)]
LOOPS = [(100 + i, 100 + (i + 1) % 17) for i in range(17)] + [(130, 131), (131, 132), (132, 130)]
#: A loop at a fork, an edge alone, three ways between two forks.
FORKS = [(140, 141), (141, 142), (142, 143), (143, 141), (150, 151), (160, 161), (161, 162), (160, 163), (163, 162), (160, 164), (164, 162)]


def test_filaments_by_ranking(spark):
    nodes, edges = graph_of(spark, TREE + LOOPS + FORKS, 170)
    want = fil.find_filaments(nodes, edges).orderBy("fil_id").collect()
    with limited(edges=-1):
        got = fil.find_filaments(nodes, edges).orderBy("fil_id").collect()
    assert len(got) == len(want) > 20
    for a, b in zip(got, want, strict=True):
        assert (a.fil_id, a.type, a.nodes, a.edges) == (b.fil_id, b.type, b.nodes, b.edges)
        assert np.allclose((a.length, a.curvature), (b.length, b.curvature))


def test_a_loop_of_many_nodes(spark):
    n = 100_000
    order = rnd.permutation(n)
    nodes, edges = graph_of(spark, np.stack((order, np.roll(order, -1)), 1), n)
    with limited(edges=-1):
        (found,) = fil.find_filaments(nodes, edges).collect()
    at = int(np.flatnonzero(order == 0)[0])
    ahead = np.roll(order, -at)
    want = ahead if ahead[1] < ahead[-1] else np.concatenate((ahead[:1], ahead[:0:-1]))
    assert found.type == 0 and found.nodes == [*want.tolist(), 0] and len(found.edges) == n


def brute_diameter(pairs):
    held = dense.Compact(*np.asarray(pairs).T)
    return max(int(held.hops_from(np.array([i])).max()) for i in range(len(held.ids)))


@pytest.mark.parametrize("most", [200_000, -1])
def test_diameter_by_bounds(spark, most):
    pairs = TREE[:30] + FORKS
    nodes, edges = graph_of(spark, pairs, 170)
    with limited(edges=most):
        assert graph.diameter(nodes, edges) == brute_diameter(pairs)
        assert graph.diameter(nodes, edges.limit(0)) == 0


def test_diameters_of_graphs_need_few_searches():
    trees = ([(i, i + 1) for i in range(300)], [(i, int(rnd.integers(max(0, i - 5), i))) for i in range(1, 400)], [(i, i // 2) for i in range(1, 500)])
    mixed = (TREE + LOOPS + FORKS, [(int(a), int(b)) for a, b in rnd.integers(0, 400, (700, 2)) if a != b])
    for pairs, share in [*((t, 0.03) for t in trees), *((m, 0.35) for m in mixed)]:
        held, searches = dense.Compact(*np.asarray(pairs).T), []
        assert held.diameter(searches) == brute_diameter(pairs)
        assert sum(searches) <= share * len(held.ids)


def test_path_by_doubling(spark):
    nodes, edges = graph_of(spark, [*TREE, (0, 60)], 80)
    want = [tuple(r) for r in graph.shortest_path(edges, 0, 79).orderBy("step").collect()]
    with limited(edges=-1):
        assert [tuple(r) for r in graph.shortest_path(edges, 0, 79).orderBy("step").collect()] == want
    assert want[0] == (0, 0) and want[-1][1] == 79
    assert graph.shortest_path(edges, 0, 0).collect() == [(0, 0)] and graph.shortest_path(edges, 0, 999).count() == 0


def test_searches_longer_than_merged_fronts(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGED_FRONTS", 3)
    nodes, edges = graph_of(spark, [(i, i + 1) for i in range(12)] + [(4, 20), (20, 5)], 21)
    with limited(edges=-1):
        got = {(r.source, r.node): r.hops for r in graph.hop_distances(edges, nodes.where("node in (0, 7)")).collect()}
        with pytest.raises(RuntimeError):
            graph.hop_distances(edges, nodes.where("node = 0"), most_rounds=3)
    assert {k: v for k, v in got.items() if k[1] <= 12} == {(s, n): abs(s - n) for s in (0, 7) for n in range(13)} and got[0, 20] == 5
