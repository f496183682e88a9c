import random

import pytest

from crestline.operators import filaments, graph
from crestline.operators.state import limited


def make(spark, xy, edges):
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "node bigint, x double, y double")
    return nodes, spark.createDataFrame(edges, "src bigint, dst bigint")


PATH = ([(i, 0) for i in range(5)], [(0, 1), (1, 2), (2, 3), (3, 4)])
STAR = ([(0, 0), (1, 0), (-1, 0), (0, 1)], [(0, 1), (0, 2), (0, 3)])
LOOP = ([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 1), (1, 2), (2, 3), (0, 3)])
#: A long arm, a second long arm, and a short one, at node 3; node 9 is alone and has a coordinate of 0.
FORK = ([(-3, 1), (-2, 1), (-1, 1), (0, 1), (1, 1), (2, 1), (3, 1), (0, 1.1), (4, 1), (0, 0)], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 7), (6, 8)])
TWO_FORKS = ([(0, 0), (1, 0), (2, 0), (3, 0), (1, 1), (2, 1)], [(0, 1), (1, 2), (2, 3), (1, 4), (2, 5)])


@pytest.fixture(params=["at once", "by joins"])
def either_way(request):
    with limited(**({"edges": -1} if request.param == "by joins" else {})):
        yield


def found(nodes, edges):
    return {(r.type, tuple(r.nodes)): r for r in filaments.find_filaments(nodes, edges).collect()}


def test_paths_stars_and_loops(spark, either_way):
    assert set(found(*make(spark, *PATH))) == {(1, (0, 1, 2, 3, 4))}
    assert set(found(*make(spark, *STAR))) == {(2, (1, 0)), (2, (2, 0)), (2, (3, 0))}
    assert {k for k, _ in found(*make(spark, *LOOP))} == {0}


def test_adjacent_bifurcations_once_and_loop_beside_a_tree(spark):
    rows = found(*make(spark, *TWO_FORKS))
    assert (3, (1, 2)) in rows and len(rows) == 5
    xy = LOOP[0] + [(9, 9), (10, 9)]
    assert {k for k, _ in found(*make(spark, xy, LOOP[1] + [(4, 5)]))} == {0, 1}


def test_lengths_and_curvature(spark):
    row = found(*make(spark, *PATH))[1, (0, 1, 2, 3, 4)]
    assert row.length == 4 and abs(row.curvature) < 1e-12
    assert all(0 <= r.curvature <= 1 for r in found(*make(spark, *FORK)).values())


def test_refinement_goes_on_until_no_arm_is_short(spark):
    # the short arm at node 0 ends in a fork of two short arms
    fork = ([(0, 0), (10, 0), (-10, 0), (0, 1), (-1, 2), (1, 2)], [(0, 1), (0, 2), (0, 3), (3, 4), (3, 5)])
    nodes, _ = filaments.refine(*make(spark, *fork), 1.6)
    assert {r.node_before for r in nodes.collect()} == {0, 1, 2}
    with pytest.raises(RuntimeError):
        filaments.refine(*make(spark, *fork), 1.6, most_rounds=1)


def test_refinement_drops_short_arms_and_keeps_a_node_at_zero(spark, either_way):
    nodes, edges = filaments.refine(*make(spark, *FORK), 0.5)
    assert sorted(r.node_before for r in nodes.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert sorted(r.node for r in nodes.collect()) == list(range(9))
    assert edges.count() == 7


def test_short_branches(spark):
    nodes, edges = make(spark, *FORK)
    assert {r.node for r in graph.cut_short_branches(nodes, edges, 1).collect()} == set(range(10)) - {7}
    left = {r.node for r in graph.cut_short_branches_fully(nodes, edges, 1).collect()}
    assert left == {0, 1, 2, 3, 4, 5, 6, 8}


def test_onion_layers(spark, either_way):
    rows = {r.node: (r.coreness, r["layer"], r.global_layer) for r in graph.onion_layers(*make(spark, *PATH)).collect()}
    assert rows == {0: (1, 1, 1), 4: (1, 1, 1), 1: (1, 2, 2), 3: (1, 2, 2), 2: (1, 3, 3)}
    loop = {r.coreness for r in graph.onion_layers(*make(spark, *LOOP)).collect()}
    assert loop == {1} or loop == {2}


def test_distances_components_and_giant(spark, either_way):
    nodes, edges = make(spark, *FORK)
    assert graph.diameter(nodes, edges) == 7
    hops = {(r.source, r.node): r.hops for r in graph.hop_distances(edges, nodes.where("node = 0")).collect()}
    assert hops[0, 8] == 7 and (0, 9) not in hops
    assert {r.node: r.comp for r in graph.components(nodes, edges).collect()} == {**{i: 0 for i in range(9)}, 9: 9}
    assert {r.node for r in graph.giant_component(nodes, edges).where("in_giant = 0").collect()} == {9}
    far = {r.node: r.len for r in graph.path_lengths(nodes, edges, nodes.where("node = 0")).collect()}
    assert abs(far[8] - 7) < 1e-9


def test_degrees_and_laplacian(spark):
    nodes, edges = make(spark, *FORK)
    deg = {r.node: r.deg for r in graph.degree(nodes, edges).collect()}
    assert sum(deg.values()) == 2 * len(FORK[1]) and deg[9] == 0
    assert abs(sum(r.val for r in graph.laplacian(nodes, edges).collect())) < 1e-12


def test_connectivity_events(spark, either_way):
    nodes, edges = make(spark, *FORK)
    rows = filaments.connectivity_events((0.0, 1.0), 2.5, nodes, edges).collect()
    assert [(r.node, r.event, r.connectivity) for r in rows if r.node == 3] == [(3, 3, 3)]
    assert {r.node: r.event for r in rows} == {3: 3, 7: -1}
    assert graph.giant_component(nodes, edges.limit(0)).select("in_giant").distinct().first()[0] == -1


def test_shortest_path_and_edge_numbers(spark, either_way):
    nodes, edges = make(spark, *FORK)
    assert [r.node for r in graph.shortest_path(edges, 8, 7).orderBy("step").collect()] == [8, 6, 5, 4, 3, 7]
    assert graph.shortest_path(edges, 0, 9).count() == 0
    asked = spark.createDataFrame([(1, 0), (0, 1), (0, 5)], "src bigint, dst bigint")
    rows = {(r.src, r.dst): r.edge_id for r in graph.edge_id_of(graph.numbered(edges), asked).collect()}
    assert rows == {(1, 0): 0, (0, 1): 0, (0, 5): None}


def test_filament_objects(spark):
    nodes, edges = make(spark, *STAR)
    table = filaments.find_filaments(nodes, edges)
    objects = filaments.to_objects(table)
    assert [f.nodes for f in objects] == [[1, 0], [2, 0], [3, 0]] and "bifurcation" in objects[0].summary()
    assert [f.nodes for f in filaments.to_objects(filaments.to_table(spark, objects))] == [[1, 0], [2, 0], [3, 0]]


def layers_of(spark, edges, n, **more):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    return {r.node: (r.coreness, r["layer"], r.global_layer) for r in graph.onion_layers(nodes, spark.createDataFrame(edges, "src bigint, dst bigint"), **more).collect()}


@pytest.mark.parametrize("cores", [False, True])
def test_layers_of_trees_are_those_of_peeling(spark, cores):
    draw, edges, n = random.Random(8), [], 0
    for size in [2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 40, 40, 40, 150]:
        for shape in range(4):
            # paths, bushes, combs; and trees on a loop or on a clique
            back = {0: 1, 1: size, 2: 3, 3: 2}[shape]
            edges += [(n + i, n + max(0, i - draw.randrange(1, back + 1))) for i in range(1, size)]
            if cores and size > 6:
                edges += [(n, n + 4)] if shape else [(n + i, n + j) for i in range(5) for j in range(i)]
            n += size
    names = list(range(n))
    draw.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges] + [(5, 5)]
    want = layers_of(spark, edges, n + 3)
    with limited(edges=-1):
        assert layers_of(spark, edges, n + 3) == want


def test_layers_of_a_long_path_take_few_rounds(spark):
    n, rounds = 10_000, []
    with limited(edges=-1):
        got = layers_of(spark, [(i, i + 1) for i in range(n - 1)], n, searches=rounds)
    assert got == {i: (1, *[min(i, n - 1 - i) + 1] * 2) for i in range(n)}
    assert len(rounds) <= 15
