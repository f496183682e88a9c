"""Registered queries: one or more for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import geometry as g
from crestline.functions import stats
from crestline.operators import filaments as fil
from crestline.operators import graph, mixture, resample, spatial, topology
from crestline.operators.fit import MOST_NODES, FitParameters, bootstrap_fits, fit_from_points, fit_graph
from crestline.operators.fit_tables import fit_tables
from crestline.operators.solve import solve
from crestline.operators.state import limited
from crestline.plans.fixtures import ALPHA, AREA, KSIG, SIG, as_nodes, events, neighbour_edges, p2, p3, parts, seeds, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(name or c)


def r4(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 4).alias(name or c)


# statistics and geometry


@query
def bandwidth(spark, d):
    return stats.bandwidth(parts(spark, d)).select(r6("h"), r6("sig"))


@query
def bounding_box(spark, d):
    return stats.bounding_box(events(spark, d)).select(*[r6(c) for c in ("min_x", "max_x", "min_y", "max_y", "shortest")])


@query
def summary(spark, d):
    return stats.summary(table(spark, d, "events"), "value").select(r6("mean"), r6("max"), r6("min"), "n")


@query
def weighted_median(spark, d):
    return stats.weighted_median(parts(spark, d), "y", "x", ["y", "id"]).select(r6("median"))


@query
def density_map(spark, d):
    return stats.density_map(events(spark, d), 64, 48).select("ix", "iy", r6("density"))


@query
def grid_hessian(spark, d):
    grid = table(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("long")).alias("ix"), F.col("l_linenumber").cast("long").alias("iy")).agg(F.count("*").cast("double").alias("v"))
    return stats.hessian(grid).select("ix", "iy", *[r6(c) for c in ("v", "g_ix", "g_iy", "h_ix_ix", "h_ix_iy", "h_iy_ix", "h_iy_iy")])


@query
def short_numbers(spark, d):
    return parts(spark, d).select("id", g.short_number(F.col("y"), 1).alias("short"))


@query
def vector_algebra(spark, d):
    u, v = g.columns("xyz"), [F.col("y"), F.col("z"), F.col("x")]
    return p3(spark, d).select(
        "id", r6(g.dot(u, v), "dot"), r6(g.length(u), "length"), r6(g.distance(u, v), "distance"), r6(g.unit(u)[0], "unit_x"), r6(g.vector(u, v)[0], "step_x"), r6(g.add(u, g.scale(v, 2.0))[2], "sum_z")
    )


@query
def segment_distance(spark, d):
    """Distance of each part to the segment from (1, 900) to (50, 2000), and the foot."""
    p, a, b = g.columns("xy"), [F.lit(1.0), F.lit(900.0)], [F.lit(50.0), F.lit(2000.0)]
    foot = g.foot_on_segment(p, a, b)
    return parts(spark, d).select("id", r6(g.segment_distance(p, a, b), "dist"), r6(foot[0], "foot_x"), r6(foot[1], "foot_y"))


@query
def eigenvalues_2d(spark, d):
    c = stats.covariance(table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")), ["l_suppkey"], "xy")
    large, small = g.eigenvalues_2d(F.col("c_xx"), F.col("c_yy"), F.col("c_xy"))
    long, short, angle = g.ellipse_2d(F.col("c_xx"), F.col("c_yy"), F.col("c_xy"), 0.9)
    return c.select("l_suppkey", r6(large, "e1"), r6(small, "e2"), r6(long, "long_axis"), r6(short, "short_axis"), r6(angle, "angle"))


@query
def eigenvalues_3d(spark, d):
    rows = p3(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    c = stats.covariance(rows, ["label"], "xyz")
    values = g.eigenvalues_3d(*[F.col(f"c_{n}") for n in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return c.select("label", *[r6(v, f"e{i}") for i, v in enumerate(values, 1)])


# neighbours and topologies


@query
def range_join(spark, d):
    found = spatial.range_join(p2(spark, d), seeds(spark, d), 0.05)
    return found.select(F.col("l_id").alias("id"), F.col("r_id").alias("node"), r6("d2"))


@query
def knn(spark, d):
    return topology.knn(as_nodes(p2(spark, d)), 6).select("src", "dst", "rank", r6("d2"))


@query
def knn_graph(spark, d):
    return topology.knn_graph(as_nodes(p2(spark, d)), 10)


@query
def reciprocal_knn_graph(spark, d):
    return topology.reciprocal_knn_graph(as_nodes(p2(spark, d)), 15)


@query
def fixed_length_graph(spark, d):
    return topology.fixed_length_graph(as_nodes(p2(spark, d)), 0.02)


@query
def sphere_of_influence(spark, d):
    return topology.sphere_of_influence(as_nodes(p2(spark, d)), 2.0)


@query
def ellipsoid_graph(spark, d):
    return topology.ellipsoid(as_nodes(p2(spark, d)), 0.05, margin=-1e9, border=1e9)


@query
def gradient_graph(spark, d):
    info = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding")[2].cast("double").alias("info"))
    return topology.gradient_graph(as_nodes(p2(spark, d)).join(info, "node"), "info", 10, 4)


@query
def full_graph(spark, d):
    return topology.full_graph(seeds(spark, d))


@query
def relative_neighbours(spark, d):
    return topology.relative_neighbours(as_nodes(p2(spark, d)))


@query
def delaunay_graph(spark, d):
    return topology.delaunay(as_nodes(p2(spark, d)))


@query
def mst(spark, d):
    return topology.mst(as_nodes(p2(spark, d)))


@query
def mst_by_rounds(spark, d):
    return topology.boruvka(as_nodes(p2(spark, d)))


@query
def bootstrap_frequency(spark, d):
    return topology.bootstrap_frequency(as_nodes(p2(spark, d)), 20).select("src", "dst", r6("freq"))


@query
def bootstrap_mst(spark, d):
    return topology.bootstrap_mst(as_nodes(p2(spark, d)), 20)


@query
def merged_trees(spark, d):
    return topology.merged_trees(as_nodes(p2(spark, d)), 10, 0.75, 3.0).select("src", "dst", r6("p"))


@query
def best_fixed_length(spark, d):
    nodes = seeds(spark, d).persist()
    r, most = topology.best_fixed_length(nodes, [0.03, 0.06, 0.09])
    rw, most_w = topology.best_fixed_length(nodes, [0.03, 0.06, 0.09], weighted=True)
    return spark.createDataFrame([("hops", r, float(most)), ("length", rw, round(most_w, 6))], "kind string, radius double, diameter double")


@query
def best_giant(spark, d):
    r, most = topology.best_giant(seeds(spark, d).persist(), [0.03, 0.06, 0.09])
    return spark.createDataFrame([(r, int(most))], "radius double, size bigint")


@query
def best_ellipsoid(spark, d):
    r, most = topology.best_ellipsoid(seeds(spark, d).persist(), [0.03, 0.06, 0.09])
    return spark.createDataFrame([(r, int(most))], "radius double, diameter bigint")


@query
def remove_short_edges(spark, d):
    nodes = as_nodes(p2(spark, d))
    return topology.remove_short_edges(nodes, topology.mst(nodes), 0.01)[1]


# graph measures


@query
def neighbour_lists(spark, d):
    return graph.neighbour_edges(graph.neighbour_lists(neighbour_edges(spark, d)))


@query
def edge_weights(spark, d):
    return graph.edge_weights(as_nodes(p2(spark, d)), neighbour_edges(spark, d)).select("src", "dst", r6("w"))


@query
def numbered_edges(spark, d):
    return graph.numbered(neighbour_edges(spark, d))


@query
def adjacency(spark, d):
    return graph.adjacency(neighbour_edges(spark, d))


@query
def adjacency_dense(spark, d):
    return graph.adjacency(neighbour_edges(spark, d), dense=True)


@query
def degree(spark, d):
    return graph.degree(as_nodes(p2(spark, d)), neighbour_edges(spark, d))


@query
def laplacian(spark, d):
    return graph.laplacian(as_nodes(p2(spark, d)), neighbour_edges(spark, d))


@query
def edge_lines(spark, d):
    lines = graph.edge_lines(as_nodes(p2(spark, d)), neighbour_edges(spark, d))
    return lines.select("src", "dst", *[r6(F.col(c)[i], f"{c}{i}") for c in "xy" for i in (0, 1)], F.size("x").cast("int").alias("n"))


@query
def components(spark, d):
    return graph.components(as_nodes(p2(spark, d)), neighbour_edges(spark, d))


@query
def giant_component(spark, d):
    return graph.giant_component(as_nodes(p2(spark, d)), neighbour_edges(spark, d))


@query
def hop_distances(spark, d):
    """Hops from the least node to all it reaches."""
    nodes = as_nodes(p2(spark, d))
    return graph.hop_distances(neighbour_edges(spark, d), nodes.agg(F.min("node").alias("node")))


@query
def path_lengths(spark, d):
    nodes = as_nodes(p2(spark, d))
    return graph.path_lengths(nodes, topology.mst(nodes), nodes.agg(F.min("node").alias("node"))).select("source", "node", "hops", r6("len"))


@query
def shortest_path(spark, d):
    """From the least node to the greatest along the tree."""
    nodes = as_nodes(p2(spark, d))
    ends = nodes.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
    return graph.shortest_path(topology.mst(nodes), ends.a, ends.b)


@query
def edge_numbers(spark, d):
    edges = neighbour_edges(spark, d)
    return graph.edge_id_of(graph.numbered(edges), edges)


@query
def graph_diameter(spark, d):
    """Of the tree of all points."""
    nodes = as_nodes(p2(spark, d))
    return spark.createDataFrame([(int(graph.diameter(nodes, topology.mst(nodes))),)], "diameter bigint")


@query
def onion_layers(spark, d):
    return graph.onion_layers(as_nodes(p2(spark, d)), neighbour_edges(spark, d))


@query
def tree_layers(spark, d):
    """Layers of the tree of all points."""
    nodes = as_nodes(p2(spark, d))
    return graph.onion_layers(nodes, topology.mst(nodes))


@query
def pruned_nodes(spark, d):
    nodes = as_nodes(p2(spark, d))
    return graph.prune(nodes, topology.mst(nodes), 2).select("node")


@query
def short_branches_cut(spark, d):
    nodes = as_nodes(p2(spark, d))
    return graph.cut_short_branches(nodes, topology.mst(nodes), 3).select("node")


@query
def short_branches_cut_fully(spark, d):
    nodes = as_nodes(p2(spark, d))
    return graph.cut_short_branches_fully(nodes, topology.mst(nodes), 3).select("node")


# mixture


def _resp(spark, d, background: bool):
    return mixture.responsibilities(p2(spark, d), seeds(spark, d), ksig=KSIG, alpha=ALPHA, area=AREA, background=background)


@query
def e_step(spark, d):
    return _resp(spark, d, False).select("id", "node", r6("r"))


@query
def e_step_background(spark, d):
    return _resp(spark, d, True).select("id", "node", r6("r"))


@query
def row_normalise(spark, d):
    rows = mixture.row_normalise(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("v")), "l_orderkey", "v", "share", 1.0)
    return rows.select("l_orderkey", "l_linenumber", r6("share"))


@query
def softmax_responsibility(spark, d):
    return mixture.softmax_responsibility(p2(spark, d), seeds(spark, d)).select("id", "node", r6("r"))


@query
def densities(spark, d):
    return mixture.densities(p2(spark, d), seeds(spark, d)).select("id", "node", r6("p"))


@query
def full_covariance_e_step(spark, d):
    near = mixture.neighbour_covariance(p2(spark, d), seeds(spark, d), 20)
    nodes = seeds(spark, d).join(near, "node")
    return mixture.full_covariance_responsibilities(p2(spark, d), nodes).select("id", "node", r6("r"))


@query
def node_sums(spark, d):
    return mixture.node_sums(p2(spark, d), _resp(spark, d, True)).select("node", *[r6(c) for c in ("n", "s_x", "s_y", "s_xx", "s_xy", "s_yy")])


@query
def weighted_covariance(spark, d):
    return mixture.weighted_covariance(p2(spark, d), seeds(spark, d), _resp(spark, d, True)).select("node", *[r6(c) for c in ("n", "c_xx", "c_xy", "c_yy")])


@query
def weighted_covariance_3d(spark, d):
    nodes = seeds(spark, d, 3)
    resp = mixture.responsibilities(p3(spark, d), nodes, ksig=KSIG, dims="xyz")
    return mixture.weighted_covariance(p3(spark, d), nodes, resp, "xyz").select("node", *[r6(f"c_{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz")])


@query
def mixture_update(spark, d):
    return mixture.mixture_update(p2(spark, d), seeds(spark, d), _resp(spark, d, True)).select("node", r6("n"), r6("sig"), r6("pi"))


@query
def background_share(spark, d):
    return mixture.background_share(p2(spark, d), _resp(spark, d, True)).select(r6("alpha"))


@query
def smoothed_variance(spark, d):
    found = mixture.mixture_update(p2(spark, d), seeds(spark, d), _resp(spark, d, True)).select("node", "n", F.col("sig").alias("sig0"))
    nodes = seeds(spark, d).join(found, "node")
    return mixture.smoothed_variance(nodes, topology.full_graph(nodes), 5.0).select("node", r6("sig"))


@query
def log_likelihood(spark, d):
    return mixture.log_likelihood(p2(spark, d), seeds(spark, d)).select(r4("ll"))


@query
def objective(spark, d):
    nodes = seeds(spark, d)
    return mixture.objective(p2(spark, d), nodes, topology.full_graph(nodes), 1.0, alpha=ALPHA, area=AREA, background=True).select(r4("objective"))


@query
def local_objective(spark, d):
    return mixture.local_objective(p2(spark, d), seeds(spark, d)).select("node", r4("value"))


@query
def mixture_density(spark, d):
    return mixture.mixture_density(p2(spark, d), seeds(spark, d)).select("id", r6("density"))


@query
def neighbour_covariance(spark, d):
    return mixture.neighbour_covariance(p2(spark, d), seeds(spark, d), 20).select("node", "n", *[r6(c) for c in ("c_xx", "c_xy", "c_yy")])


# fits, filaments, replicas


def _model(spark, d, **options):
    par = FitParameters(lam=5.0, lam_sig=5.0, lam_pi=1.0, max_rounds=5, sig=SIG, background=True, alpha=ALPHA, ksig=KSIG, **options)
    return fit_graph(p2(spark, d), seeds(spark, d).select("node", "x", "y"), par)


@query
def fit(spark, d):
    model = _model(spark, d)
    return model.nodes(spark).select("node", r6("x"), r6("y"), r6("sig"), r6("pi"))


@query
def fit_fixed_variance(spark, d):
    return _model(spark, d, update="fixed").nodes(spark).select("node", r6("x"), r6("y"), r6("sig"), r6("pi"))


@query
def fit_events(spark, d):
    """A fit to all events with as many nodes as hours of the day."""
    points = events(spark, d)
    nodes = points.groupBy(F.floor("y").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    model = fit_graph(points, nodes, FitParameters(lam=1.0, max_rounds=3, sig=100.0, background=True, alpha=0.1))
    return model.nodes(spark).select("node", r4("x"), r4("y"), r4("sig"), r6("pi"))


@query
def fit_edges(spark, d):
    return _model(spark, d).edge_table(spark)


def _tree(spark, d):
    nodes = as_nodes(p2(spark, d)).persist()
    return nodes, graph.numbered(topology.mst(nodes)).persist()


@query
def find_filaments(spark, d):
    nodes, edges = _tree(spark, d)
    found = fil.find_filaments(nodes, edges)
    return found.select("fil_id", "type", r6("length"), r6("curvature"), F.concat_ws(",", F.transform("nodes", lambda v: v.cast("string"))).alias("path"))


@query
def filament_labels(spark, d):
    model = _model(spark, d)
    nodes, edges = model.nodes(spark), model.edge_table(spark)
    return fil.assign_labels(p2(spark, d), nodes, fil.find_filaments(nodes, edges), alpha=model.alpha, area=model.area, background=True)


@query
def in_pattern(spark, d):
    return fil.in_pattern(p2(spark, d), seeds(spark, d), ksig=KSIG, alpha=ALPHA, area=AREA, background=True)


@query
def filament_residuals(spark, d):
    model = _model(spark, d)
    nodes, edges = model.nodes(spark), model.edge_table(spark)
    found = fil.find_filaments(nodes, edges)
    labels = fil.assign_labels(p2(spark, d), nodes, found, ksig=7.0)
    return fil.filament_residuals(p2(spark, d), nodes, edges, found, labels).select("id", "label", r6("residual"))


@query
def described_filaments(spark, d):
    model = _model(spark, d)
    nodes, edges = model.nodes(spark), model.edge_table(spark)
    found = fil.describe_filaments(p2(spark, d), nodes, edges, fil.find_filaments(nodes, edges))
    return found.select("fil_id", "type", r6("length"), F.size("assignment").alias("n_points"), F.size("residuals").alias("n_residuals"), F.size("uncertainty").alias("n_nodes"))


@query
def skeleton_distance(spark, d):
    nodes = seeds(spark, d).persist()
    return fil.skeleton_distance(p2(spark, d), nodes, topology.full_graph(nodes)).select("id", r6("distance"))


@query
def refined_graph(spark, d):
    nodes, edges = _tree(spark, d)
    new, left = fil.refine(nodes, edges, 0.02)
    return new.select("node", "node_before", r6("x"), r6("y"))


@query
def refined_edges(spark, d):
    nodes, edges = _tree(spark, d)
    return fil.refine(nodes, edges, 0.02)[1]


@query
def connectivity_events(spark, d):
    nodes, edges = _tree(spark, d)
    return fil.connectivity_events((0.0, 0.0), 0.1, nodes, edges).select("node", "event", r6("euclidean"), r6("geodesic"), "connectivity")


def _replicas(spark, d):
    n = p2(spark, d).count()
    return topology.subsamples(as_nodes(p2(spark, d)), 10, int(n * 0.75), n=n).persist()


@query
def subsamples(spark, d):
    return topology.subsamples(as_nodes(p2(spark, d)), 5, 100).select("rep", "node")


@query
def edge_samples(spark, d):
    seg = graph.ends(as_nodes(p2(spark, d)), neighbour_edges(spark, d))
    seg = seg.withColumn("n", g.distance(g.columns("xy", "a_"), g.columns("xy", "b_")) / 0.005)
    return resample.sampled_segments(seg, "n", "xy", ["src", "dst"]).select("src", "dst", r6("x"), r6("y"))


@query
def probability_map(spark, d):
    """Edges of a replica are those of the neighbour graph between its points."""
    nodes = _replicas(spark, d)
    flat = graph.canonical(neighbour_edges(spark, d))
    a, b = (nodes.select("rep", F.col("node").alias(c)) for c in ("src", "dst"))
    edges = flat.join(a, "src").join(b, ["rep", "dst"])
    return resample.probability_map(p2(spark, d), nodes, edges, 32).select("i_x", "i_y", r6("p"))


@query
def position_uncertainty(spark, d):
    return resample.position_uncertainty(seeds(spark, d), _replicas(spark, d)).select("node", r6("rho"))


@query
def bootstrap_fit_nodes(spark, d):
    """Nodes of three fits to samples, after pruning."""
    par = FitParameters(reps=3, max_rounds=2, lam=1.0, denoising=2)
    nodes, _ = bootstrap_fits(p2(spark, d), par.with_bandwidth(p2(spark, d)))
    return nodes.select("rep", "node", r6("x"), r6("y"))


@query
def stream_scores(spark, d):
    """Components of points by the scorer that also runs on streams."""
    from crestline.streaming.scorer import score

    model = _model(spark, d)
    return score(p2(spark, d), model, KSIG).select("id", "node", r6("r"))


@query
def edge_text_round_trip(spark, d):
    import uuid

    from crestline.operators.state import shared_path
    from crestline.sources.edge_text import read_edges, write_edges

    path = f"{shared_path(spark)}/edges-{uuid.uuid4().hex}"
    write_edges(neighbour_edges(spark, d), path)
    return read_edges(spark, path)


@query
def catalog_round_trip(spark, d):
    import uuid

    from crestline.operators.state import shared_path
    from crestline.sources.catalog import read_catalog, write_catalog

    path = f"{shared_path(spark)}/catalog-{uuid.uuid4().hex}"
    model = _model(spark, d)
    found = fil.find_filaments(model.nodes(spark), model.edge_table(spark))
    write_catalog(path, p2(spark, d), model, found, FitParameters(lam=5.0))
    return read_catalog(spark, path)[1].nodes(spark).select("node", r6("x"), r6("y"), r6("sig"), r6("pi"))


# the distributed ways of operators that hold small data in one place, with the same results


def distributed(name: str, over: str) -> None:
    """Register the query `name` again under name_over, with nothing held in one place."""
    once = QUERIES[name]

    def run(spark, d):
        with limited(edges=-1, points=-1, neighbours=-1, nodes=-1):
            return once(spark, d)

    run.__doc__ = once.__doc__
    QUERIES[f"{name}_{over}"] = run


for _name in ("knn", "sphere_of_influence", "relative_neighbours", "delaunay_graph", "position_uncertainty"):
    distributed(_name, "by_cells")
for _name in ("numbered_edges", "components", "hop_distances", "onion_layers"):
    distributed(_name, "by_rounds")
for _name in ("fit_fixed_variance", "fit_events"):
    distributed(_name, "by_passes")


@query
def tree_layers_by_rounds(spark, d):
    """Layers of the tree of all points, by pointers that double."""
    nodes = as_nodes(p2(spark, d))
    tree = topology.mst(nodes)
    with limited(edges=-1):
        return graph.onion_layers(nodes, tree)


@query
def bootstrap_frequency_by_rounds(spark, d):
    """The trees of all samples grow in the same rounds."""
    with limited(nodes=-1):
        return topology.bootstrap_frequency(as_nodes(p2(spark, d)), 20).select("src", "dst", r6("freq"))


@query
def path_lengths_by_rounds(spark, d):
    """From the least node along edges to the nearest neighbours."""
    nodes = as_nodes(p2(spark, d))
    with limited(edges=-1):
        return graph.path_lengths(nodes, neighbour_edges(spark, d), nodes.agg(F.min("node").alias("node"))).select("source", "node", "hops", r6("len"))


@query
def find_filaments_by_rounds(spark, d):
    nodes, edges = _tree(spark, d)
    with limited(edges=-1):
        found = fil.find_filaments(nodes, edges)
    return found.select("fil_id", "type", r6("length"), r6("curvature"), F.concat_ws(",", F.transform("nodes", lambda v: v.cast("string"))).alias("path"))


@query
def ends_and_loops(spark, d):
    """The filaments that do not run between bifurcations."""
    nodes, edges = _tree(spark, d)
    return fil.find_filaments(nodes, edges, between=False).select("fil_id", "type", r6("length"))


@query
def e_step_by_join(spark, d):
    """Responsibilities where nodes are too many to be held."""
    return mixture.responsibilities(p2(spark, d), seeds(spark, d), ksig=KSIG, alpha=ALPHA, area=AREA, background=True, small_nodes=-1).select("id", "node", r6("r"))


@query
def filament_residuals_by_join(spark, d):
    model = _model(spark, d)
    nodes, edges = model.nodes(spark), model.edge_table(spark)
    found = fil.find_filaments(nodes, edges)
    labels = fil.assign_labels(p2(spark, d), nodes, found, ksig=7.0)
    with limited(edges=-1):
        return fil.filament_residuals(p2(spark, d), nodes, edges, found, labels).select("id", "label", r6("residual"))


@query
def filament_objects(spark, d):
    """Filaments of the model as objects on the driver and back as a table."""
    model = _model(spark, d)
    found = fil.to_table(spark, fil.to_objects(fil.find_filaments(model.nodes(spark), model.edge_table(spark))))
    return found.select("fil_id", "type", r6("length"), F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


@query
def npy_round_trip(spark, d):
    """Points written as a .npy file in the shared folder and read from there."""
    import io
    import uuid

    import numpy as np

    from crestline.operators.state import shared_path
    from crestline.sources.points import read_npy

    rows = p2(spark, d).orderBy("id").toArrow()
    path = f"{shared_path(spark)}/points-{uuid.uuid4().hex}.npy"
    held = io.BytesIO()
    np.save(held, np.stack([rows.column(c).to_numpy() for c in "xy"], 1))
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(there)
    out.write(bytearray(held.getvalue()))
    out.close()
    return read_npy(spark, path).select("id", r6("x"), r6("y"))


@query
def parameter_table(spark, d):
    """Parameters of a fit, changed and shown line by line, with the bandwidth of the parts."""
    par = FitParameters().changed(lam=5.0, background=True, alpha=ALPHA).with_bandwidth(parts(spark, d))
    lines = [line.split(" = ", 1) for line in par.show().splitlines()]
    wanted = {"lam", "lam_sig", "lam_pi", "max_rounds", "reps", "share", "ksig", "alpha", "sig"}
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in lines if k in wanted], "name string, value double")


@query
def position_solve(spark, d):
    """Positions that solve (lam L + diag) F = right over the tree of all points, with unit weights, by rounds of elimination."""
    nodes = as_nodes(p2(spark, d))
    edges = topology.mst(nodes)
    with limited(edges=-1):
        found = solve(nodes.withColumn("ridge", F.lit(1.0)), edges, 2.0)
    return found.select("node", r6("x"), r6("y"))


def _fit_points(spark, d, most_nodes: int):
    """A fit with all points as nodes, but for the outer layers of their tree."""
    par = FitParameters(lam=1.0, max_rounds=2, denoising=2)
    return fit_from_points(p2(spark, d), par.with_bandwidth(p2(spark, d)), most_nodes=most_nodes).nodes(spark).select("node", r6("x"), r6("y"), r6("sig"), r6("pi"))


@query
def fit_points(spark, d):
    return _fit_points(spark, d, MOST_NODES)


@query
def fit_points_by_tables(spark, d):
    """The same with a model that is a table."""
    return _fit_points(spark, d, -1)


@query
def fit_by_tables(spark, d):
    """The fit of `fit` with a model that is a table."""
    par = FitParameters(lam=5.0, lam_sig=5.0, lam_pi=1.0, max_rounds=5, sig=SIG, background=True, alpha=ALPHA, ksig=KSIG)
    return fit_tables(p2(spark, d), seeds(spark, d).select("node", "x", "y"), par).nodes().select("node", r6("x"), r6("y"), r6("sig"), r6("pi"))
