import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import dense, spatial, topology
from crestline.operators.state import limited


def nodes_of(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "node bigint, x double, y double")


def pairs(df):
    return {(min(r.src, r.dst), max(r.src, r.dst)) for r in df.collect()}


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(5).normal(size=(120, 2))


def kruskal(x):
    edges = sorted((((x[i] - x[j]) ** 2).sum(), i, j) for i, j in itertools.combinations(range(len(x)), 2))
    comp, out = list(range(len(x))), set()
    for _, i, j in edges:
        if comp[i] != comp[j]:
            out.add((i, j))
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    return out


def test_tree_is_minimum_and_inside_the_proximity_graphs(spark, cloud):
    nodes = nodes_of(spark, cloud)
    tree = pairs(topology.mst(nodes))
    assert tree == kruskal(cloud)
    rng = pairs(topology.relative_neighbours(nodes))
    assert tree <= rng <= pairs(topology.delaunay(nodes))


def test_tree_by_rounds_of_joins_is_the_same(spark, cloud):
    few = cloud[:40]
    with limited(edges=-1):
        assert pairs(topology.boruvka(nodes_of(spark, few), k=3)) == kruskal(few)


def test_trees_of_large_replicas_grow_by_rounds(spark, cloud):
    both = nodes_of(spark, cloud[:30]).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1)))).where("rep = 0 or node < 20")
    got = {(r.rep, r.src, r.dst) for r in topology.mst(both, rep="rep", local_nodes=5).collect()}
    assert got == {(r.rep, r.src, r.dst) for r in topology.mst(both, rep="rep").collect()}


def test_trees_of_replicas_grow_in_the_same_rounds(spark, cloud, monkeypatch):
    # unlike sizes, one of a single node; names that are no numbers; negative ids; a grid full of ties; far groups that need several rounds
    grid = [(float(i % 6), float(i // 6)) for i in range(36)]
    far = [(*(p + 1000 * (i % 4)),) for i, p in enumerate(cloud[:60])]
    rows = [(name, 3 * i - 50, float(a), float(b)) for name, x in (("grid", grid), ("far", far), ("one", grid[:1]), ("b", cloud[:25])) for i, (a, b) in enumerate(x)]
    nodes = spark.createDataFrame(rows, "rep string, node bigint, x double, y double")
    want = {("grid", *e) for e in tree_of(grid)} | {("far", *e) for e in tree_of(far)} | {("b", *e) for e in tree_of(cloud[:25])}
    calls = []
    monkeypatch.setattr(topology, "boruvka", lambda *a, run=topology.boruvka, **b: calls.append(1) or run(*a, **b))
    for edges in (-1, 200_000):
        with limited(edges=edges):
            got = [(r.rep, r.src, r.dst) for r in topology.mst(nodes, rep="rep", local_nodes=5).collect()]
        assert set(got) == want and len(got) == len(want)
    assert len(calls) == 2


def tree_of(x):
    return {(3 * i - 50, 3 * j - 50) for i, j in kruskal(np.array(x))}


def test_quadratic_graphs_have_a_bound(spark, cloud):
    with pytest.raises(ValueError):
        topology.full_graph(nodes_of(spark, cloud), most_nodes=100)


def test_samples_are_those_of_the_smallest_digests(spark):
    import hashlib

    nodes = spark.range(3000).withColumnRenamed("id", "node")
    for size in (0, 10, 1500, 2999, 3000):
        got = topology.subsamples(nodes, 3, size, seed=4).collect()
        for rep in range(3):
            order = sorted(range(3000), key=lambda i: (hashlib.md5(f"4|{rep}|{i}".encode()).hexdigest(), i))
            assert sorted(r.node for r in got if r.rep == rep) == sorted(order[:size])


def test_coincident_points_and_squares_give_trees(spark):
    x = np.array([[0, 0], [0, 0], [1, 0], [1, 1], [0, 1]])
    assert len(pairs(topology.mst(nodes_of(spark, x)))) == 4
    assert len(pairs(topology.mst(nodes_of(spark, x[:1])))) == 0


def test_relative_neighbours_against_definition(spark, cloud):
    x = cloud[:50]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(i, j) for i, j in itertools.combinations(range(50), 2) if not any(d[i, r] < d[i, j] and d[j, r] < d[i, j] for r in range(50) if r not in (i, j))}
    assert pairs(topology.relative_neighbours(nodes_of(spark, x))) == want
    assert pairs(topology.relative_neighbours(nodes_of(spark, x), local_nodes=0)) == want


def test_delaunay_circles_are_empty():
    x = np.random.default_rng(2).uniform(size=(40, 2))
    edges = {tuple(e) for e in dense.delaunay_pairs(x).tolist()}
    want = set()
    for a, b, c in itertools.combinations(range(40), 3):
        left = 2 * np.array([x[b] - x[a], x[c] - x[a]])
        centre = np.linalg.solve(left, [(x[b] ** 2).sum() - (x[a] ** 2).sum(), (x[c] ** 2).sum() - (x[a] ** 2).sum()])
        r2 = ((x[a] - centre) ** 2).sum()
        if not (np.delete(((x - centre) ** 2).sum(1), [a, b, c]) < r2).any():
            want |= {(a, b), (a, c), (b, c)}
    assert edges == want


@pytest.mark.parametrize("most", [20_000, 0])
def test_nearest_neighbours_both_ways(spark, cloud, most):
    x = np.concatenate((cloud[:60], [[40.0, -30.0]]))
    with limited(neighbours=most):
        got = {(r.src, r["rank"]): r.dst for r in topology.knn(nodes_of(spark, x), 6).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:5]
        assert [got[i, r] for r in range(1, 6)] == order


def test_range_join_with_radius_of_each_node(spark, cloud):
    points = nodes_of(spark, cloud).withColumnRenamed("node", "id")
    nodes = nodes_of(spark, cloud[:10]).withColumn("reach", F.when(F.col("node") == 9, 50.0).when(F.col("node") == 8, 0.0).otherwise(0.1 + F.col("node") * 0.1))
    got = {(r.l_id, r.r_id) for r in spatial.range_join(points, nodes, "reach").collect()}
    assert got == {(i, j) for i in range(120) for j in range(10) if math.dist(cloud[i], cloud[j]) <= (50 if j == 9 else 0 if j == 8 else 0.1 + j * 0.1)}


def test_merged_trees_fold(spark, cloud):
    found = topology.merged_trees(nodes_of(spark, cloud[:40]), 5, 0.75, 3.0).collect()
    assert pairs(topology.mst(nodes_of(spark, cloud[:40]))) <= {(r.src, r.dst) for r in found}
    assert all(0 <= r.p <= 1 + 1e-9 for r in found)


def test_ellipsoid_keeps_the_ball_where_points_are_few(spark, cloud):
    nodes = nodes_of(spark, cloud[:12])
    assert pairs(topology.ellipsoid(nodes, 1.0)) == pairs(topology.fixed_length_graph(nodes, 1.0))


def test_relative_neighbours_of_many_lose_no_pair(spark):
    # two far groups, each with more nodes than lists are long; copies; a grid full of ties; space
    draw = np.random.default_rng(3)
    sets = [np.vstack([draw.normal(size=(60, 2)), draw.normal(size=(60, 2)) + [300, 7]]), np.array([(i % 7, i // 7) for i in range(42)] + [(3, 3)] * 3 + [(50, 2)] * 2), draw.normal(size=(70, 3))]
    for x in sets:
        dims = "xyz"[: x.shape[1]]
        nodes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "node bigint, " + ", ".join(f"{d} double" for d in dims))
        got = [(r.src, r.dst) for r in topology.relative_neighbours_of_many(nodes, dims, k=4, first=8).collect()]
        assert set(got) == pairs(topology.relative_neighbours(nodes, dims)) and len(got) == len(set(got))
    for n in (0, 1, 2):
        assert topology.relative_neighbours_of_many(nodes.where(f"node < {n}"), "xyz").count() == (n == 2)


def test_merged_trees_of_more_nodes_than_a_task_holds(spark, cloud):
    nodes = nodes_of(spark, cloud[:40])
    want = sorted(map(tuple, topology.merged_trees(nodes, 2, 0.5, 3.0).collect()))
    with limited(nodes=30):
        assert sorted(map(tuple, topology.merged_trees(nodes, 2, 0.5, 3.0).collect())) == want


@pytest.mark.parametrize("kind", ["even", "lattice", "coincident", "far", "space", "heavy", "line", "one place"])
def test_trees_by_cells_are_those_grown_node_by_node(kind):
    draw = np.random.default_rng(41)
    x = {
        "even": lambda: draw.normal(size=(1500, 2)),
        "lattice": lambda: np.stack(np.meshgrid(np.arange(40.0), np.arange(40.0)), -1).reshape(-1, 2)[draw.permutation(1600)],
        "coincident": lambda: draw.integers(0, 30, (1500, 2)).astype(float),
        "far": lambda: np.concatenate((draw.random((600, 2)), draw.random((600, 2)) + [1e6, 5e5])),
        "space": lambda: draw.normal(size=(1500, 3)),
        "heavy": lambda: draw.standard_cauchy((1500, 2)),
        "line": lambda: np.stack((draw.random(1500), np.zeros(1500)), 1),
        "one place": lambda: np.ones((1200, 2)),
    }[kind]()
    assert dense.spanning_tree(x).tolist() == dense.grown_tree(x).tolist()


def test_a_tree_of_many_nodes_takes_seconds():
    x = np.random.default_rng(42).normal(size=(60_000, 2))
    start = time.monotonic()
    assert len(dense.spanning_tree(x)) == len(x) - 1
    # node by node it took minutes
    assert time.monotonic() - start < 30
