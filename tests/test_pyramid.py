"""Searches that descend through cells: the same as by brute force, and how much they look at."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crestline.operators import dense, pyramid, spatial, topology
from crestline.operators.state import limited

rnd = np.random.default_rng(3)
FAR = np.concatenate((rnd.random((1500, 2)), [[1e6, 1e6]]))
SAME = np.concatenate((np.zeros((700, 2)), rnd.random((200, 2)), np.round(rnd.random((200, 2)), 1)))
CASES = {"flat": rnd.random((900, 2)), "space": rnd.random((700, 3)), "outlier": FAR, "coincident": SAME, "tight": np.concatenate((rnd.random((500, 2)), rnd.random((700, 2)) * 1e-7 + 0.5))}


def table(spark, x, name="id"):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(len(x)), **{c: x[:, j] for j, c in enumerate("xyz"[: x.shape[1]])}}))


def rows(found):
    return sorted(map(tuple, found.select("q_id", "rank", "p_id", "d2").collect()))


@pytest.fixture
def many_upper_cells(monkeypatch):
    monkeypatch.setattr(pyramid, "UPPER_POINTS", 150)


@pytest.mark.parametrize("case", CASES)
def test_neighbours_by_cells(spark, many_upper_cells, case):
    x = CASES[case]
    points, asked = table(spark, x), table(spark, x[::7] + 0.01)
    dims = "xyz"[: x.shape[1]]
    looked = []
    with limited(neighbours=-1):
        own = rows(spatial.knn_join(points, points, 5, dims=dims, exclude_self=True, looked=looked))
        other = rows(spatial.knn_join(asked, points, 3, dims=dims))
    assert own == rows(spatial.knn_join(points, points, 5, dims=dims, exclude_self=True))
    assert other == rows(spatial.knn_join(asked, points, 3, dims=dims))
    # neither an outlier nor unlike densities make a search look at all pairs
    assert looked[0] < (400 if len(dims) == 3 else 250) * len(x)


def test_neighbours_of_few_or_no_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 1.0, 0.0)], "id bigint, x double, y double")
    with limited(neighbours=-1):
        assert rows(spatial.knn_join(points.where("id in (1, 4)"), points.where("id in (1, 4)"), 5)) == [(1, 1, 1, 0.0), (1, 2, 4, 1.0), (4, 1, 4, 0.0), (4, 2, 1, 1.0)]
        assert rows(spatial.knn_join(points.where("id < 0"), points, 1)) == []
        assert rows(spatial.knn_join(points, points.where("id < 0"), 1)) == []
        assert rows(spatial.knn_join(points, points, 1)) == [(1, 1, 1, 0.0), (4, 1, 4, 0.0)]


def test_work_for_an_outlier_grows_with_the_points(spark):
    looked = []
    for n in (1000, 4000):
        x = np.concatenate((rnd.random((n, 2)), [[1e6, 1e6]]))
        with limited(neighbours=-1):
            points = table(spark, x)
            spatial.knn_join(points, points, 4, exclude_self=True, looked=looked).count()
    assert looked[1] < 6 * looked[0]


def tree(spark, x, **more):
    with limited(neighbours=-1):
        found = topology.boruvka(table(spark, x, "node"), "xyz"[: x.shape[1]], **more)
    return sorted(map(tuple, found.select("src", "dst").collect()))


def test_tree_of_two_far_clusters(spark):
    x = np.concatenate((rnd.random((500, 2)), rnd.random((500, 2)) + [1000, 500]))
    looked = []
    assert tree(spark, x, looked=looked) == [tuple(e) for e in dense.spanning_tree(x).tolist()]
    # the first is for the lists of neighbours; ways out of components come after it
    assert sum(looked[1:]) < 50 * len(x) and looked[0] < 200 * len(x)


def test_tree_with_ties_and_coincident_points(spark, many_upper_cells):
    grid = np.stack(np.meshgrid(np.arange(12.0), np.arange(12.0)), -1).reshape(-1, 2)
    x = np.concatenate((grid, grid[:40], np.full((60, 2), 3.0), [[1e5, 0]]))
    assert tree(spark, x, k=3) == [tuple(e) for e in dense.spanning_tree(x).tolist()]


def test_tree_of_clusters_in_clusters(spark):
    x = np.concatenate([rnd.random((60, 3)) * 0.01 + [a, b, 0] for a in (0, 1, 50) for b in (0, 1)])
    assert tree(spark, x, k=4) == [tuple(e) for e in dense.spanning_tree(x).tolist()]


@pytest.mark.parametrize("case", ["clusters", "grid", "space", "line"])
def test_delaunay_by_cells_is_that_of_one_task(spark, case):
    grid = np.stack(np.meshgrid(np.arange(9.0), np.arange(9.0)), -1).reshape(-1, 2)
    x = {"clusters": np.concatenate((rnd.random((150, 2)), rnd.random((100, 2)) * 0.01 + 3, [[50, 50]])), "grid": np.concatenate((grid, grid[:3])), "space": rnd.random((120, 3)), "line": np.stack((np.arange(60.0), np.zeros(60)), 1)}[case]
    want = {tuple(e) for e in dense.delaunay_pairs(x, np.arange(len(x))).tolist()}
    with limited(nodes=-1, neighbours=-1):
        got = [tuple(r) for r in topology.delaunay(table(spark, x, "node"), "xyz"[: x.shape[1]]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_neighbours_of_the_same_key(spark, many_upper_cells):
    x, keys = rnd.random((800, 2)), rnd.integers(0, 4, 800)
    points = table(spark, np.concatenate((x, x[:5])) + 0.0).join(spark.createDataFrame(pd.DataFrame({"id": np.arange(805), "rep": [*keys.tolist(), *keys[:5].tolist()]})), "id")
    asked = table(spark, x[:50]).join(points.select("id", "rep"), "id")
    got = {(r.rep, r.q_id, r["rank"]): (r.p_id, r.d2) for r in spatial.knn_join(asked, points, 3, key="rep").collect()}
    own = {(r.rep, r.q_id, r["rank"]): r.p_id for r in spatial.knn_join(points, points, 2, key="rep", exclude_self=True).collect()}
    every, held = np.concatenate((x, x[:5])), np.concatenate((keys, keys[:5]))
    for i in range(50):
        at = np.flatnonzero(held == keys[i])
        d2 = ((every[at] - x[i]) ** 2).sum(1)
        order = np.lexsort((at, d2))
        assert [got[keys[i], i, r][0] for r in (1, 2, 3)] == at[order[:3]].tolist()
        assert [own[keys[i], i, r] for r in (1, 2)] == [j for j in at[order[:3]].tolist() if j != i][:2]
    assert len(got) == 150 and len(own) == 2 * 805


def test_upper_cells_decide_most_of_a_tree(spark, many_upper_cells):
    # also places in common, on lines, and a far one
    x = np.concatenate((rnd.random((1500, 2)), np.zeros((200, 2)), np.round(rnd.random((300, 2)), 1), [[1e6, 1e6]]))
    nodes = table(spark, x, "node")
    whole = {tuple(e) for e in dense.spanning_tree(x).tolist()}
    placed = pyramid.plant(nodes, len(x), id_col="node", need=9)
    sure, label = topology.sure_edges(placed)
    found = {tuple(e) for e in sure.collect()}
    assert found <= whole and len(found) > 0.6 * len(whole) and label.select("comp").distinct().count() == len(x) - len(found)
    assert {tuple(e) for e in topology.boruvka(nodes).collect()} == whole


def test_wide_spheres_look_at_few_cells(spark, many_upper_cells):
    x = rnd.random((3000, 2))
    placed = pyramid.plant(table(spark, x), len(x))
    centre = np.array([[-1e4, 0.3], [0.5, 2e4], [0.5, 0.5]])
    r2 = np.array([(1e4 + 0.5) ** 2, 4e8, 0.04])
    spheres = spark.createDataFrame(pd.DataFrame({"item": [0, 1, 2], "c_x": centre[:, 0], "c_y": centre[:, 1], "r2": r2}))
    looked = []
    got = pyramid.inside_spheres(placed, spheres, 5, looked=looked).groupBy("item").agg(F.sort_array(F.collect_set("id")).alias("ids")).collect()
    far2 = ((centre[:, None] - x[None]) ** 2).sum(2)
    want = {i: sorted(np.lexsort((np.arange(len(x)), far2[i]))[:5].tolist()) for i in range(3)}
    assert {r["item"]: r["ids"] for r in got} == want
    # all three hold most of the points or many of them
    assert looked[0] < 600 < (far2 < r2[:, None]).sum() / 5


def test_items_are_dealt_by_the_number_of_cells(spark):
    # few bytes of items become many pairs, so Spark alone would leave as many tasks as cores, however many the points
    first = spark.range(1000).select(F.col("id").alias("item"))
    few, many = (pyramid.dealt(pyramid.Pyramid(first, bits, ("x", "y")), first).rdd.getNumPartitions() for bits in (4, 14))
    assert few == spark.sparkContext.defaultParallelism and many == (1 << 14) // pyramid.TASK_CELLS
