"""Systems and fits kept as tables: the same as those held in one place."""

import numpy as np
import pandas as pd
import pytest

from crestline.operators import dense, solve
from crestline.operators.fit import FitParameters, bootstrap_fits, fit_from_points, fit_graph
from crestline.operators.fit_tables import fit_tables
from crestline.operators.state import limited

rnd = np.random.default_rng(11)


def rows_of(spark, ridge, right):
    return spark.createDataFrame(pd.DataFrame({"node": np.arange(len(ridge)), "ridge": ridge, "x": right[:, 0], "y": right[:, 1]}))


def edges_of(spark, pairs):
    return spark.createDataFrame(pd.DataFrame(np.asarray(pairs).reshape(-1, 2), columns=["src", "dst"]))


def near_pairs(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    return np.stack((np.repeat(np.arange(len(x)), k), np.argsort(d, 1)[:, 1 : k + 1].ravel()), 1)


X = rnd.random((40, 2))
GRAPHS = {
    "tree": dense.spanning_tree(X),
    "chain and star, with isolated nodes": np.array([*[(i, i + 1) for i in range(15)], *[(20, i) for i in range(21, 35)]]),
    "cycle, listed twice": np.array([*[(i, (i + 1) % 40) for i in range(40)], (0, 1), (1, 0)]),
    "neighbours": near_pairs(X, 3),
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("most", [200_000, -1])
def test_solution_is_that_of_the_matrix(spark, name, most):
    pairs, ridge, right = GRAPHS[name], rnd.random(40) + 0.2, rnd.normal(size=(40, 2))
    with limited(edges=most):
        got = solve.solve(rows_of(spark, ridge, right), edges_of(spark, pairs), 2.0).orderBy("node").toPandas()
    want = dense.laplacian_solve(40, pairs[:, 0], pairs[:, 1], ridge, 2.0, right)
    assert got.node.tolist() == list(range(40)) and np.abs(got[["x", "y"]].to_numpy() - want).max() < 1e-9


def test_what_does_not_settle_is_an_error(spark):
    complete = np.array([(i, j) for i in range(8) for j in range(i)])
    with limited(edges=-1), pytest.raises(RuntimeError, match="settle"):
        solve.solve(rows_of(spark, np.full(8, 1e-3), rnd.normal(size=(8, 2))), edges_of(spark, complete), 1.0, most_steps=1)


def test_held_systems_beyond_the_dense_size():
    pairs = np.stack((np.arange(299), np.arange(1, 300)), 1)
    ridge, right = np.ones(300), rnd.normal(size=(300, 2))
    assert np.abs(dense.laplacian_solve(300, *pairs.T, ridge, 2.0, right, most_dense=10) - dense.laplacian_solve(300, *pairs.T, ridge, 2.0, right)).max() < 1e-10


@pytest.fixture(scope="module")
def points(spark):
    x = np.concatenate((np.stack((np.linspace(0, 1, 80), rnd.normal(0, 0.02, 80)), 1), rnd.random((40, 2))))
    rows = [(i, *map(float, p)) for i, p in enumerate(x)] + [(1000, None, 0.0), (1001, float("nan"), 0.0)]
    return spark.createDataFrame(rows, "id bigint, x double, y double").cache()


def gap(spark, a, b):
    a, b = (m.nodes(spark).toPandas().sort_values("node").to_numpy() for m in (a, b))
    return np.abs(a - b).max() if a.shape == b.shape else np.inf


@pytest.mark.parametrize("par", [FitParameters(lam=1.0, sig=0.01, background=True, alpha=0.1, max_rounds=3), FitParameters(max_rounds=2, update="fixed", topology="knn"), FitParameters(sig=0.01, max_rounds=50, eps=1e-2)])
def test_fit_by_tables_is_the_fit(spark, points, par):
    nodes = points.where("id % 4 = 0 and id < 1000").withColumnRenamed("id", "node")
    one, other = fit_graph(points, nodes, par), fit_tables(points, nodes, par)
    assert gap(spark, one, other) < 1e-9 and abs(one.alpha - other.alpha) < 1e-9 and np.allclose(one.movements, other.movements)
    assert sorted(map(tuple, one.edge_table(spark).collect())) == sorted(map(tuple, other.edge_table().collect()))


def test_fit_with_points_as_nodes(spark, points):
    finite = points.where("id < 1000")
    par = FitParameters(sig=0.01, max_rounds=2, denoising=2)
    assert gap(spark, fit_from_points(finite, par), fit_from_points(finite, par, most_nodes=-1)) < 1e-9


def test_replicas_by_tables(spark, points):
    finite = points.where("id < 60")
    par = FitParameters(sig=0.01, max_rounds=1, denoising=0, reps=2)
    one, _ = bootstrap_fits(finite, par)
    other, edges = bootstrap_fits(finite, par, local_points=-1, most_nodes=-1)
    a, b = (t.toPandas().sort_values(["rep", "node"]).to_numpy() for t in (one, other))
    assert a.shape == b.shape and np.abs(a - b).max() < 1e-9 and edges.groupBy("rep").count().count() == 2


def test_no_nodes_are_an_error(spark, points):
    with pytest.raises(ValueError):
        fit_tables(points, points.where("id < 0").withColumnRenamed("id", "node"), FitParameters(sig=1.0))


def test_larger_systems_leave_nothing_on_the_driver(spark, monkeypatch):
    pairs, ridge, right = GRAPHS["tree"], rnd.random(40) + 0.2, rnd.normal(size=(40, 2))
    brought, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "toArrow", lambda df, run=kind.toArrow: brought.append((t := run(df)).num_rows) or t)
    with limited(edges=12):
        got = solve.solve(rows_of(spark, ridge, right), edges_of(spark, pairs), 2.0).orderBy("node").toPandas()
    want = dense.laplacian_solve(40, pairs[:, 0], pairs[:, 1], ridge, 2.0, right)
    # the nodes and the edges of the system that is held, once
    assert len(brought) == 2 and max(brought) <= 12 and np.abs(got[["x", "y"]].to_numpy() - want).max() < 1e-9
