import math

import numpy as np
import pytest

from crestline.operators import dense, filaments, mixture, topology
from crestline.operators.fit import FitParameters, bootstrap_fits, fit_from_points, fit_graph
from crestline.sources.catalog import read_catalog, write_catalog
from crestline.sources.edge_text import read_edges, write_edges
from crestline.sources.points import read_npy
from crestline.streaming.scorer import score


@pytest.fixture(scope="module")
def toy(spark):
    """Three noisy arms and a cluster, with a quarter of uniform noise."""
    draw = np.random.default_rng(10)
    t = draw.uniform(0, 3, 500)
    arms = [np.stack((t * math.cos(a), t * math.sin(a)), 1) + draw.normal(0, s, (500, 2)) for a, s in ((0.3, 0.05), (2.4, 0.08), (4.5, 0.1))]
    body = np.concatenate((*arms, draw.normal(0, 0.2, (500, 2))))
    noise = draw.uniform(body.min(0), body.max(0), (len(body) // 3, 2))
    x = np.concatenate((body, noise))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, x double, y double").persist()
    seeds = x[draw.choice(len(x), 60, False)]
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(seeds)], "node bigint, x double, y double")
    return points, nodes, x, seeds


PAR = FitParameters(lam=5.0, max_rounds=30, eps=1e-5, sig=0.01, background=True, alpha=0.1)


@pytest.fixture(scope="module")
def model(toy):
    return fit_graph(toy[0], toy[1], PAR)


def test_noise_is_recovered(model):
    assert abs(model.alpha - 0.25) < 0.06


def test_rounds_equal_plain_numpy(toy):
    points, nodes, x, f = toy
    par = FitParameters(lam=5.0, max_rounds=2, sig=0.05, background=True, alpha=0.1)
    got = fit_graph(points, nodes, par)
    k, n = len(f), len(x)
    sig, pi, alpha, lam = np.full(k, 0.05), np.full(k, 0.9 / k), 0.1, 5.0 / 0.05
    area = np.prod(x.max(0) - x.min(0))
    edges = dense.spanning_tree(f)
    for t in range(2):
        d2 = ((x[:, None] - f[None]) ** 2).sum(2)
        w = np.where(d2 <= 49 * sig, pi / (2 * math.pi * sig) * np.exp(-d2 / (2 * sig)), 0)
        whole = w.sum(1) + alpha / area
        r = w / whole[:, None]
        outside = (alpha / area / whole).sum()
        nk = np.maximum(r.sum(0), par.eps)
        a = np.zeros((k, k))
        for i, j in edges:
            a[i, j] = a[j, i] = 1
        lap = np.diag(a.sum(1)) - a
        new = np.linalg.solve(lam * lap + np.diag(nk / sig), (r / sig).T @ x)
        fresh = np.array([(r[:, [j]] * (x - new[j]) ** 2).sum() / nk[j] / 2 for j in range(k)])
        alpha = outside / n
        pi = (nk / n + (1 - alpha) / k) / 2
        c = 20 / (2 * nk)
        sig = (fresh + c * (a @ sig) / a.sum(1)) / (1 + c)
        f = new
        edges = dense.spanning_tree(f)
    assert np.allclose(got.positions, f) and np.allclose(got.sig, sig) and np.allclose(got.pi, pi) and abs(got.alpha - alpha) < 1e-9


def test_passes_of_spark_give_the_same_model(toy):
    par = FitParameters(lam=5.0, max_rounds=3, sig=0.05, background=True, alpha=0.1)
    a, b = fit_graph(toy[0], toy[1], par), fit_graph(toy[0], toy[1], par, small_points=10)
    assert np.allclose(a.positions, b.positions) and np.allclose(a.sig, b.sig) and abs(a.alpha - b.alpha) < 1e-9


def test_replicas_in_tasks_equal_replicas_one_by_one(toy):
    points = toy[0].where("id < 200")
    par = FitParameters(reps=2, max_rounds=2, denoising=2, sig=0.05)
    here, there = bootstrap_fits(points, par), bootstrap_fits(points, par, local_points=10)
    a, b = ([tuple(r) for r in x[0].orderBy("rep", "node").collect()] for x in (here, there))
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2:] for r in a], [r[2:] for r in b])
    assert {tuple(sorted(r)) for r in here[1].collect()} == {tuple(sorted(r)) for r in there[1].collect()}


def test_any_builder_may_be_the_topology(toy):
    points = toy[0].where("id < 120")
    par = FitParameters(max_rounds=2, denoising=1, sig=0.05, reps=1, topology=lambda nodes: topology.mst(nodes))
    a, b = fit_from_points(points, par), fit_from_points(points, par.changed(topology="mst"))
    assert np.allclose(a.positions, b.positions) and a.edges.tolist() == b.edges.tolist()
    assert bootstrap_fits(points, par)[0].count() == bootstrap_fits(points, par.changed(topology="mst"))[0].count()


def test_sums_by_point_equal_the_join(toy, model, spark):
    nodes = model.nodes(spark)
    odd = toy[0].unionByName(spark.createDataFrame([(10_000, None, 1.0), (10_001, float("nan"), 1.0)], "id bigint, x double, y double"))
    for background in (False, True):
        ways = [mixture.responsibilities(toy[0], nodes, alpha=0.2, area=model.area, background=background, small_nodes=n) for n in (100, -1)]
        a, b = ({(r.id, r.node): r.r for r in w.collect()} for w in ways)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert mixture.log_likelihood_rows(odd, nodes).where("ll is null").count() == 2
    assert mixture.responsibilities(odd, nodes).where("id >= 10000").isEmpty()


def test_responsibilities_sum_to_one(toy, model, spark):
    resp = mixture.responsibilities(toy[0], model.nodes(spark), alpha=model.alpha, area=model.area, background=True)
    sums = [r[1] for r in resp.groupBy("id").sum("r").collect()]
    assert len(sums) == len(toy[2]) and max(abs(s - 1) for s in sums) < 1e-9


def test_objective_does_not_fall_with_fixed_graph_and_variance(toy):
    par = FitParameters(lam=1.0, max_rounds=5, sig=0.05, update="fixed", refresh_every=10**6, ksig=50.0)
    values = fit_graph(toy[0], toy[1], par, with_objective=True).objectives
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(values[4:], values[5:], strict=False))


def test_scores_equal_labels(toy, model, spark):
    want = {r.id: r.node for r in filaments.component_of(toy[0], model.nodes(spark), alpha=model.alpha, area=model.area, background=True).collect()}
    got = {r.id: r.node for r in score(toy[0], model).collect()}
    assert sum(want[i] != got[i] for i in want) <= 2  # ties by rounding at most


def test_stream(toy, model, spark, tmp_path):
    toy[0].limit(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, x double, y double").parquet(str(tmp_path / "in"))
    job = score(stream, model).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    job.awaitTermination(60)
    assert spark.table("scored").count() == 100


def test_catalog_and_text(toy, model, spark, tmp_path):
    nodes, edges = model.nodes(spark), model.edge_table(spark)
    found = filaments.find_filaments(nodes, edges)
    write_catalog(str(tmp_path / "cat"), toy[0], model, found, PAR)
    points, back, rows, par = read_catalog(spark, str(tmp_path / "cat"))
    assert par == PAR and points.count() == len(toy[2]) and rows.count() == found.count()
    assert np.array_equal(back.positions, model.positions) and {tuple(e) for e in back.edges.tolist()} == {tuple(sorted(e)) for e in model.edges.tolist()}
    write_edges(edges, str(tmp_path / "txt"))
    assert read_edges(spark, str(tmp_path / "txt")).count() == edges.count()


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(10.0).reshape(5, 2))
    rows = read_npy(spark, str(tmp_path / "a.npy")).orderBy("id").collect()
    assert [(r.id, r.x, r.y) for r in rows] == [(i, 2.0 * i, 2.0 * i + 1) for i in range(5)]


def test_large_solve_equals_dense_solve():
    draw = np.random.default_rng(0)
    n = 200
    src, dst = np.arange(n - 1), np.arange(1, n)
    ridge, right = draw.uniform(0.5, 2, n), draw.normal(size=(n, 2))
    assert np.allclose(dense.laplacian_solve(n, src, dst, ridge, 3.0, right), dense.laplacian_solve(n, src, dst, ridge, 3.0, right, most_dense=0))


def test_labels_lie_on_filaments(toy, model, spark):
    nodes, edges = model.nodes(spark), model.edge_table(spark)
    found = filaments.find_filaments(nodes, edges)
    labels = filaments.assign_labels(toy[0], nodes, found, alpha=model.alpha, area=model.area, background=True)
    rows = labels.collect()
    assert len(rows) == len(toy[2]) and {r.label for r in rows} <= {-1, *range(found.count())}
    rest = filaments.filament_residuals(toy[0], nodes, edges, found, labels)
    assert rest.where("residual < 0").isEmpty() and rest.count() == sum(r.label >= 0 for r in rows)
