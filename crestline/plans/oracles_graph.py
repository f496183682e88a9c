"""DuckDB SQL for the queries over trees, proximity graphs and fits, which need recursion."""

from __future__ import annotations

from crestline.plans.fixtures import ALPHA, KSIG, SIG, ctes

RECURSIVE = ctes("p2").replace("WITH ", "WITH RECURSIVE ", 1)
SEEDED = ctes("p2", "seeds").replace("WITH ", "WITH RECURSIVE ", 1)
EVENTS = ctes("ev").replace("WITH ", "WITH RECURSIVE ", 1)


def far2(a: str, b: str) -> str:
    return f"(({a}x - {b}x) * ({a}x - {b}x) + ({a}y - {b}y) * ({a}y - {b}y))"


def prim(name: str, points: str) -> str:
    """Minimum spanning trees of points(rep, id, x, y): the CTE name(rep, src, dst). A row is a point outside of the tree
    with its shortest way in; each step takes the least way of every replica, ties by (length, src, dst)."""
    new = f"((x - nx) * (x - nx) + (y - ny) * (y - ny))"
    closer = f"({new} < d2 OR ({new} = d2 AND (least(id, nid) < a OR (least(id, nid) = a AND greatest(id, nid) < b))))"
    step = "OVER (PARTITION BY rep ORDER BY d2, a, b)"
    return f"""{name}_root AS MATERIALIZED (SELECT rep, min(id) AS id, arg_min(x, id) AS x, arg_min(y, id) AS y FROM {points} GROUP BY rep),
    {name}_steps(rep, id, x, y, d2, a, b, pick) AS (
        SELECT p.rep, p.id, p.x, p.y, {far2('p.', 'r.')}, least(p.id, r.id), greatest(p.id, r.id), false FROM {points} p JOIN {name}_root r ON r.rep = p.rep WHERE p.id <> r.id
        UNION ALL
        SELECT rep, id, x, y, CASE WHEN id <> nid AND {closer} THEN {new} ELSE d2 END, CASE WHEN id <> nid AND {closer} THEN least(id, nid) ELSE a END, CASE WHEN id <> nid AND {closer} THEN greatest(id, nid) ELSE b END, id = nid
        FROM (SELECT *, first_value(id) {step} AS nid, first_value(x) {step} AS nx, first_value(y) {step} AS ny FROM {name}_steps WHERE NOT pick)),
    {name} AS MATERIALIZED (SELECT rep, a AS src, b AS dst FROM {name}_steps WHERE pick)"""


def solved(name: str, rows: str) -> str:
    """Gauss and Jordan's elimination of rows(i, v), i from 1 and v a list of the matrix row and the right sides: name(i, v)."""
    return f"""{name}_steps(k, i, v) AS (SELECT 0, i, v FROM {rows} UNION ALL
        SELECT k + 1, i, CASE WHEN i = k + 1 THEN list_transform(v, lambda c: c / v[k + 1]) ELSE list_transform(v, lambda c, j: c - v[k + 1] / lead_row[k + 1] * lead_row[j]) END
        FROM (SELECT *, max(CASE WHEN i = k + 1 THEN v END) OVER () AS lead_row, count(*) OVER () AS n FROM {name}_steps) WHERE k < n),
    {name} AS MATERIALIZED (SELECT i, v FROM {name}_steps WHERE k = (SELECT count(*) FROM {rows}))"""


def settled(name: str, rows: str, ways: str, lam: float | str, steps: int) -> str:
    """Jacobi's iteration for rows(i, d, x, y), d the ridge, over ways(a, b) in both directions: name(i, v), v the list of both sides. It needs no
    matrix, so it suits many nodes; steps must let it rest."""
    return f"""{name}_rows AS MATERIALIZED (SELECT i, d + {lam}::DOUBLE * count(*) AS d, x, y FROM {rows} JOIN {ways} ON a = i GROUP BY i, d, x, y),
    {name}_steps(k, i, x, y) AS (SELECT 0, i, x / d, y / d FROM {name}_rows UNION ALL
        SELECT s.k + 1, r.i, (r.x + {lam}::DOUBLE * sum(s.x)) / r.d, (r.y + {lam}::DOUBLE * sum(s.y)) / r.d FROM {name}_steps s JOIN {ways} w ON w.b = s.i JOIN {name}_rows r ON r.i = w.a WHERE s.k < {steps} GROUP BY s.k, r.i, r.x, r.y, r.d),
    {name} AS MATERIALIZED (SELECT i, [x, y] AS v FROM {name}_steps WHERE k = {steps})"""


def fit(points: str, nodes: str, rounds: int, *, lam: float | str, sig: float | str, alpha: float, ksig: float, lam_sig: float = 5.0, lam_pi: float = 1.0, fixed: bool = False, steps: int | None = None) -> str:
    """A fit of nodes(node, x, y) to points(id, x, y) over the tree: m{rounds}(i, node, x, y, sig, pi), s{rounds}(alpha, area) and g{rounds}(src, dst). Systems are
    eliminated, or iterated if steps are given."""
    out = [
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY node) AS i, node, x, y, {sig}::DOUBLE AS sig, (1 - {alpha}) / (SELECT count(*) FROM {nodes}) AS pi FROM {nodes})",
        f"s0 AS MATERIALIZED (SELECT {alpha}::DOUBLE AS alpha, (max(x) - min(x)) * (max(y) - min(y)) AS area, count(*) AS n FROM {points})",
        "t0 AS (SELECT 0 AS rep, node AS id, x, y FROM m0)",
        prim("g0", "t0"),
    ]
    for t in range(rounds):
        out += [
            f"w{t} AS MATERIALIZED (SELECT p.id, m.i, p.x - m.x AS dx, p.y - m.y AS dy, m.pi * pow(2 * pi() * m.sig, -1.0) * exp(-{far2('p.', 'm.')} / (2 * m.sig)) AS w FROM {points} p JOIN m{t} m ON {far2('p.', 'm.')} <= {ksig}::DOUBLE * {ksig}::DOUBLE * m.sig)",
            f"r{t} AS MATERIALIZED (SELECT i, dx, dy, w / (sum(w) OVER (PARTITION BY id) + alpha / area) AS r FROM w{t}, s{t})",
            f"""n{t} AS MATERIALIZED (SELECT m.*, coalesce(sum(r), 0) AS n, greatest(coalesce(sum(r), 0), 1e-6) AS wt, coalesce(sum(r * dx), 0) AS fx, coalesce(sum(r * dy), 0) AS fy, coalesce(sum(r * dx * dx), 0) AS sx, coalesce(sum(r * dy * dy), 0) AS sy
                FROM m{t} m LEFT JOIN r{t} ON r{t}.i = m.i GROUP BY ALL)""",
            f"e{t} AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM g{t} JOIN m{t} a ON a.node = src JOIN m{t} b ON b.node = dst UNION ALL SELECT b.i, a.i FROM g{t} JOIN m{t} a ON a.node = src JOIN m{t} b ON b.node = dst)",
            f"l{t} AS MATERIALIZED (SELECT i, wt / sig AS d, (fx + n * x) / sig AS x, (fy + n * y) / sig AS y FROM n{t})" if steps is not None else f"""l{t} AS MATERIALIZED (SELECT n.i, list_concat(list_transform(range(1, (SELECT count(*) FROM m{t}) + 1), lambda j: CASE WHEN j = n.i THEN {lam}::DOUBLE * len(around) + n.wt / n.sig WHEN list_contains(around, j) THEN -{lam}::DOUBLE ELSE 0.0::DOUBLE END),
                [(n.fx + n.n * n.x) / n.sig, (n.fy + n.n * n.y) / n.sig]) AS v FROM n{t} n JOIN (SELECT a, list(b) AS around FROM e{t} GROUP BY a) ON a = n.i)""",
            solved(f"f{t}", f"l{t}") if steps is None else settled(f"f{t}", f"l{t}", f"e{t}", lam, steps),
            f"s{t + 1} AS MATERIALIZED (SELECT greatest(0.0, n - (SELECT sum(r) FROM r{t})) / n AS alpha, area, n FROM s{t})",
            f"near{t} AS MATERIALIZED (SELECT a AS i, avg(sig) AS around FROM e{t} JOIN m{t} ON m{t}.i = b GROUP BY a)",
        ]
        moved = f"SELECT n.*, f.v[-2] AS nx, f.v[-1] AS ny, f.v[-2] - n.x AS mx, f.v[-1] - n.y AS my, {4 * lam_sig}::DOUBLE / (2 * n.wt) AS c, around FROM n{t} n JOIN f{t} f ON f.i = n.i JOIN near{t} ON near{t}.i = n.i"
        fresh = "((sx - 2 * mx * fx + mx * mx * n) / wt + (sy - 2 * my * fy + my * my * n) / wt) / 2"
        sized = "sig, (1 - alpha) / k AS pi" if fixed else f"({fresh} + c * around) / (1 + c) AS sig, (wt / total + {lam_pi}::DOUBLE * (1 - alpha) / k) / (1 + {lam_pi}::DOUBLE) AS pi"
        out += [
            f"m{t + 1} AS MATERIALIZED (SELECT i, node, nx AS x, ny AS y, {sized} FROM ({moved}), (SELECT alpha, n AS total, (SELECT count(*) FROM m{t}) AS k FROM s{t + 1}))",
            f"t{t + 1} AS (SELECT 0 AS rep, node AS id, x, y FROM m{t + 1})",
            prim(f"g{t + 1}", f"t{t + 1}"),
        ]
    return ", ".join(out)


#: The model of the queries over a fit, as m5, s5 and g5.
MODEL = f"{SEEDED}, {fit('p2', 'seeds', 5, lam=5.0 / SIG, sig=SIG, alpha=ALPHA, ksig=KSIG)}"
NODES = "SELECT node, round(x, 6) AS x, round(y, 6) AS y, round(sig, 6) AS sig, round(pi, 6) AS pi FROM m5"
#: Filaments of the model's tree: fils(fil_id, type, len, path).
FILAMENTS = f"""way AS MATERIALIZED (SELECT src AS u, dst AS v FROM g5 UNION ALL SELECT dst, src FROM g5),
    far AS MATERIALIZED (SELECT u, v, sqrt({far2('a.', 'b.')}) AS w FROM way JOIN m5 a ON a.node = u JOIN m5 b ON b.node = v), deg AS MATERIALIZED (SELECT u AS node, count(*) AS d FROM way GROUP BY u),
    walk(path, len) AS (SELECT [u, v], w FROM far JOIN deg ON node = u WHERE d <> 2 UNION ALL
        SELECT list_append(path, f.v), len + f.w FROM walk JOIN deg ON deg.node = path[-1] AND deg.d = 2 JOIN far f ON f.u = path[-1] AND f.v <> path[-2]),
    ended AS (SELECT path, len, a.d AS d1, b.d AS d2 FROM walk JOIN deg a ON a.node = path[1] JOIN deg b ON b.node = path[-1] AND b.d <> 2),
    kept AS (SELECT path, len, CASE WHEN d1 > 1 THEN 3 WHEN d2 > 1 THEN 2 ELSE 1 END AS type FROM ended WHERE (d1 = 1 AND d2 > 1) OR ((d1 = 1) = (d2 = 1) AND path[1] < path[-1])),
    fils AS MATERIALIZED (SELECT row_number() OVER (ORDER BY type = 3, path) - 1 AS fil_id, type, len, path FROM kept)"""


def labels(ksig: float, floor: str) -> str:
    """labels(id, label): the last filament that holds the node with the largest share in a point, if nodes hold more of it than the background."""
    return f"""lw AS MATERIALIZED (SELECT p.id, m.node, m.pi * pow(2 * pi() * m.sig, -1.0) * exp(-{far2('p.', 'm.')} / (2 * m.sig)) AS w FROM p2 p JOIN m5 m ON {far2('p.', 'm.')} <= {ksig}::DOUBLE * {ksig}::DOUBLE * m.sig),
    lt AS (SELECT id, arg_min(node, (-w, node)) AS node, sum(w) AS inside FROM lw GROUP BY id),
    lf AS (SELECT unnest(path) AS node, fil_id FROM fils), ll AS (SELECT node, max(fil_id) AS fil_id FROM lf GROUP BY node),
    labels AS MATERIALIZED (SELECT p2.id, coalesce(ll.fil_id, -1) AS label FROM p2 LEFT JOIN lt ON lt.id = p2.id AND lt.inside > 0 AND lt.inside >= {floor} LEFT JOIN ll ON ll.node = lt.node)"""


RESIDUALS = f"""pieces AS (SELECT fil_id, unnest(range(1, len(path))) AS k, path FROM fils), seg AS (SELECT fil_id, a.x AS ax, a.y AS ay, b.x - a.x AS vx, b.y - a.y AS vy FROM pieces JOIN m5 a ON a.node = path[k] JOIN m5 b ON b.node = path[k + 1]),
    residual AS (SELECT id, label, min(sqrt(pow(x - ax - t * vx, 2) + pow(y - ay - t * vy, 2))) AS residual FROM (SELECT id, label, x, y, seg.*, greatest(0.0, least(1.0, ((x - ax) * vx + (y - ay) * vy) / (vx * vx + vy * vy))) AS t
        FROM labels JOIN p2 USING (id) JOIN seg ON seg.fil_id = label) GROUP BY id, label)"""


def sampled(reps: int, size: str) -> str:
    """Samples as drawn(rep, id, x, y)."""
    return f"""ranks AS (SELECT rep, id, x, y, row_number() OVER (PARTITION BY rep ORDER BY md5('0|' || rep || '|' || id), id) AS p FROM p2, range({reps}) t(rep)),
    drawn AS MATERIALIZED (SELECT rep, id, x, y FROM ranks WHERE p <= {size})"""


FREQUENCY = f"""{RECURSIVE}, {sampled(20, "least(CAST(floor((SELECT count(*) FROM p2) * 0.75) AS BIGINT) + 1, (SELECT count(*) FROM p2))")}, {prim('trees', 'drawn')},
    freq AS MATERIALIZED (SELECT src, dst, count(*) / 20.0::DOUBLE AS freq FROM trees GROUP BY src, dst)"""
WHOLE = f"whole AS (SELECT 0 AS rep, id, x, y FROM p2), {prim('tree', 'whole')}"

#: Layers of p2 over the edges flat, by peeling step by step.
LAYERS = """peel(src, dst, core, layer, step) AS (SELECT u, v, 1, 1, 1 FROM (SELECT src AS u, dst AS v FROM flat UNION ALL SELECT dst, src FROM flat) UNION ALL
            SELECT src, dst, CASE WHEN least_left > core THEN core + 1 ELSE core END, CASE WHEN least_left > core THEN 1 ELSE layer + 1 END, step + 1 FROM (
                SELECT *, min(left_here) OVER () AS least_left FROM (SELECT *, count(*) OVER (PARTITION BY src) AS left_here FROM (
                    SELECT *, count(*) OVER (PARTITION BY src) AS ds, count(*) OVER (PARTITION BY dst) AS dd FROM peel) WHERE ds > core AND dd > core))),
        taken AS (SELECT src AS node, any_value(core) AS coreness, any_value(layer) AS layer, step FROM peel GROUP BY src, step HAVING count(*) <= any_value(core)),
        last AS (SELECT core, layer + 1 AS layer FROM peel ORDER BY step DESC LIMIT 1)
        SELECT id AS node, CAST(coalesce(coreness, core) AS INT) AS coreness, CAST(coalesce(taken.layer, last.layer) AS INT) AS layer, CAST(coalesce(step, last.layer) AS INT) AS global_layer FROM p2 LEFT JOIN taken ON node = id, last"""

#: Graphs of radius r over the seeds, and the fewest hops and shortest lengths between their nodes.
RADII = f"""{SEEDED}, radii AS (SELECT unnest([0.03::DOUBLE, 0.06::DOUBLE, 0.09::DOUBLE]) AS r),
    near AS MATERIALIZED (SELECT r, a.node AS u, b.node AS v, sqrt({far2('a.', 'b.')}) AS w FROM radii, seeds a JOIN seeds b ON a.node <> b.node WHERE {far2('a.', 'b.')} <= r * r),
    paths(r, root, node, hops, len) AS (SELECT r, node, node, 0, 0.0::DOUBLE FROM radii, seeds UNION ALL
        SELECT p.r, p.root, n.v, p.hops + 1, min(p.len + n.w) FROM paths p JOIN near n ON n.r = p.r AND n.u = p.node WHERE p.hops < (SELECT count(*) FROM seeds) GROUP BY p.r, p.root, n.v, p.hops),
    apart AS MATERIALIZED (SELECT r, root, node, min(hops) AS hops, min(len) AS len FROM paths GROUP BY r, root, node),
    wide AS (SELECT r, max(hops) AS hops, max(len) AS len FROM apart GROUP BY r)"""

def refined(shortest: float, depth: int = 8) -> str:
    """Branches from an end to a bifurcation shorter than shortest go, round by round: alive(step, u, v, w, du, dv). A branch
    has depth edges at most, which the data at hand keep by far."""
    joins, ends = [], []
    for k in range(2, depth + 1):
        joins.append(f"LEFT JOIN alive e{k} ON e{k - 1}.dv = 2 AND e{k}.u = e{k - 1}.v AND e{k}.v <> e{k - 1}.u")
    for k in range(1, depth + 1):
        path = ", ".join(f"e{i}.u" for i in range(1, k + 1))
        ends.append(f"WHEN e{k}.dv > 2 THEN CASE WHEN {' + '.join(f'e{i}.w' for i in range(1, k + 1))} < {shortest}::DOUBLE THEN [{path}] END")
    return f"""first AS (SELECT u, v, sqrt({far2('a.', 'b.')}) AS w FROM (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree) JOIN p2 a ON a.id = u JOIN p2 b ON b.id = v),
    alive(step, u, v, w, du, dv) AS (SELECT 0, u, v, w, count(*) OVER (PARTITION BY u), count(*) OVER (PARTITION BY v) FROM first UNION ALL
        SELECT step + 1, u, v, w, count(*) OVER (PARTITION BY u), count(*) OVER (PARTITION BY v) FROM (SELECT a.*, gone FROM alive a, (
            SELECT list(node) AS gone FROM (SELECT unnest(CASE {' '.join(ends)} END) AS node FROM alive e1 {' '.join(joins)} WHERE e1.du = 1))) WHERE gone IS NOT NULL AND NOT list_contains(gone, u) AND NOT list_contains(gone, v)),
    left_over AS MATERIALIZED (SELECT DISTINCT u, v FROM alive WHERE step = (SELECT max(step) FROM alive)),
    named AS MATERIALIZED (SELECT u, row_number() OVER (ORDER BY u) - 1 AS node FROM (SELECT DISTINCT u FROM left_over))"""


ORACLES: dict[str, str] = {
    "delaunay_graph": f"""{RECURSIVE}, pairs AS (SELECT a.id AS src, b.id AS dst, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS nx, b.x - a.x AS ny, {far2('a.', 'b.')} / 4 AS h2 FROM p2 a JOIN p2 b ON a.id < b.id),
        sides AS (SELECT src, dst, (c.x - mx) * nx + (c.y - my) * ny AS side, (c.x - mx) * (c.x - mx) + (c.y - my) * (c.y - my) - h2 AS over FROM pairs JOIN p2 c ON c.id <> src AND c.id <> dst),
        room AS (SELECT src, dst, max(over / (2 * side)) FILTER (side < 0) AS low, min(over / (2 * side)) FILTER (side > 0) AS high FROM sides GROUP BY src, dst)
        SELECT src, dst FROM room WHERE low IS NULL OR high IS NULL OR low < high""",
    "bootstrap_frequency": f"{FREQUENCY} SELECT src, dst, round(freq, 6) AS freq FROM freq",
    "bootstrap_mst": f"{FREQUENCY}, {WHOLE} SELECT src, dst FROM freq WHERE freq > 0.35::DOUBLE UNION SELECT src, dst FROM tree",
    "best_fixed_length": f"""{RADII} SELECT 'hops' AS kind, arg_min(r, (-hops, r)) AS radius, CAST(max(hops) AS DOUBLE) AS diameter FROM wide
        UNION ALL SELECT 'length', arg_min(r, (-len, r)), round(max(len), 6) FROM wide""",
    "best_giant": f"{RADII}, sizes AS (SELECT r, max(n) AS n FROM (SELECT r, root, count(*) AS n FROM apart GROUP BY r, root) GROUP BY r) SELECT arg_min(r, (-n, r)) AS radius, max(n) AS size FROM sizes",
    "best_ellipsoid": f"{RADII} SELECT arg_min(r, (-hops, r)) AS radius, CAST(max(hops) AS BIGINT) AS diameter FROM wide",
    "onion_layers": f"""{ctes('p2', 'near', 'edges', 'flat').replace('WITH ', 'WITH RECURSIVE ', 1)}, {LAYERS}""",
    "tree_layers": f"{RECURSIVE}, {WHOLE}, flat AS (SELECT src, dst FROM tree), {LAYERS}",
    "short_branches_cut_fully": f"""{RECURSIVE}, {WHOLE},
        alive(step, u, v, du, dv) AS (SELECT 0, u, v, count(*) OVER (PARTITION BY u), count(*) OVER (PARTITION BY v) FROM (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree) UNION ALL
            SELECT step + 1, u, v, count(*) OVER (PARTITION BY u), count(*) OVER (PARTITION BY v) FROM (
                SELECT a.step, a.u, a.v, bool_or(a.u IN gone OR a.v IN gone) AS hit FROM alive a, (
                    SELECT list(node) AS gone FROM (
                        SELECT unnest(CASE WHEN e.dv <> 2 THEN [e.u] WHEN f.dv <> 2 THEN [e.u, e.v] ELSE [e.u, e.v, f.v] END) AS node FROM alive e LEFT JOIN alive f ON e.dv = 2 AND f.u = e.v AND f.v <> e.u LEFT JOIN alive g ON f.dv = 2 AND g.u = f.v AND g.v <> f.u
                        WHERE e.du = 1 AND (e.dv <> 2 OR (f.dv > 2) OR (f.dv = 1) OR (f.dv = 2 AND g.dv > 2)))) GROUP BY a.step, a.u, a.v, gone HAVING gone IS NOT NULL) WHERE NOT hit)
        SELECT DISTINCT u AS node FROM alive WHERE step = (SELECT max(step) FROM alive)""",
    "refined_graph": f"{RECURSIVE}, {WHOLE}, {refined(0.02)} SELECT node, id AS node_before, round(x, 6) AS x, round(y, 6) AS y FROM named JOIN p2 ON id = u",
    "refined_edges": f"{RECURSIVE}, {WHOLE}, {refined(0.02)} SELECT row_number() OVER (ORDER BY a.node, b.node) - 1 AS edge_id, a.node AS src, b.node AS dst FROM left_over l JOIN named a ON a.u = l.u JOIN named b ON b.u = l.v WHERE l.u < l.v",
    "fit": f"{MODEL} {NODES}",
    "fit_fixed_variance": f"{SEEDED}, {fit('p2', 'seeds', 5, lam=5.0 / SIG, sig=SIG, alpha=ALPHA, ksig=KSIG, fixed=True)} {NODES}",
    "fit_edges": f"{MODEL} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst FROM g5",
    "fit_events": f"""{EVENTS}, hours AS MATERIALIZED (SELECT CAST(floor(y) AS BIGINT) AS node, avg(x) AS x, avg(y) AS y FROM ev GROUP BY 1), {fit('ev', 'hours', 3, lam=1.0 / 100.0, sig=100.0, alpha=0.1, ksig=7.0)}
        SELECT node, round(x, 4) AS x, round(y, 4) AS y, round(sig, 4) AS sig, round(pi, 6) AS pi FROM m3""",
    "catalog_round_trip": f"{MODEL} {NODES}",
    "stream_scores": f"""{MODEL}, w AS (SELECT p.id, m.node, m.pi * pow(2 * pi() * m.sig, -1.0) * exp(-{far2('p.', 'm.')} / (2 * m.sig)) AS w FROM p2 p JOIN m5 m ON {far2('p.', 'm.')} <= {KSIG}::DOUBLE * {KSIG}::DOUBLE * m.sig),
        t AS (SELECT id, arg_min(node, (-w, node)) AS node, max(w) AS top, sum(w) AS inside FROM w GROUP BY id)
        SELECT p2.id, coalesce(node, -1) AS node, round(coalesce(top / (inside + alpha / area), 0), 6) AS r FROM p2 CROSS JOIN s5 LEFT JOIN t ON t.id = p2.id AND inside / (inside + alpha / area) >= 0.5""",
    "filament_labels": f"{MODEL}, {FILAMENTS}, {labels(3.0, '(SELECT alpha / area FROM s5)')} SELECT id, label FROM labels",
    "filament_residuals": f"{MODEL}, {FILAMENTS}, {labels(7.0, '0')}, {RESIDUALS} SELECT id, label, round(residual, 6) AS residual FROM residual",
    "described_filaments": f"""{MODEL}, {FILAMENTS}, {labels(7.0, '0')}, {RESIDUALS}, held AS (SELECT label, count(*) AS n FROM residual GROUP BY label)
        SELECT fil_id, CAST(type AS INT) AS type, round(len, 6) AS length, CAST(coalesce(n, 0) AS INT) AS n_points, CAST(coalesce(n, 0) AS INT) AS n_residuals, CAST(len(path) AS INT) AS n_nodes FROM fils LEFT JOIN held ON label = fil_id""",
}

ORACLES["parameter_table"] = f"""{ctes('parts')}, s AS (SELECT count(*) AS n, least(stddev_pop(x), stddev_pop(y)) AS m FROM parts), h AS (SELECT 0.1 * pow(1 / 4.0, 1 / 6.0) * pow(n, -1 / 6.0) * m AS h FROM s)
    SELECT name, value FROM (VALUES ('lam', 5.0::DOUBLE), ('lam_sig', 5.0), ('lam_pi', 1.0), ('max_rounds', 10.0), ('reps', 100.0), ('share', 0.75), ('ksig', 7.0), ('alpha', {ALPHA})) v(name, value) UNION ALL SELECT 'sig', round(h * h, 6) FROM h"""
ORACLES["npy_round_trip"] = f"{ctes('p2')} SELECT row_number() OVER (ORDER BY id) - 1 AS id, round(x, 6) AS x, round(y, 6) AS y FROM p2"
ORACLES["filament_objects"] = f"{MODEL}, {FILAMENTS} SELECT fil_id, CAST(type AS INT) AS type, round(len, 6) AS length, CAST(len(path) AS INT) AS n_nodes, CAST(len(path) - 1 AS INT) AS n_edges FROM fils"
ORACLES["filament_residuals_by_join"] = ORACLES["filament_residuals"]
ORACLES["position_solve"] = f"""{RECURSIVE}, {WHOLE}, ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM tree UNION ALL SELECT dst, src FROM tree), ridges AS (SELECT id AS i, 1.0::DOUBLE AS d, x, y FROM p2),
    {settled('f0', 'ridges', 'ways', 2.0, 400)} SELECT i AS node, round(v[1], 6) AS x, round(v[2], 6) AS y FROM f0"""

#: Points that stay as nodes after two rounds of peeling the tree's ends, as nodes and points of a fit; the bandwidth of P2.
PEELED = f"""{prim('g', 'own')}, way AS MATERIALIZED (SELECT src AS u, dst AS v FROM g UNION ALL SELECT dst, src FROM g),
    first AS (SELECT u FROM way GROUP BY u HAVING count(*) = 1), inner1 AS (SELECT u, v FROM way WHERE u NOT IN (SELECT u FROM first) AND v NOT IN (SELECT u FROM first)),
    second AS (SELECT u FROM inner1 GROUP BY u HAVING count(*) = 1), kept AS MATERIALIZED (SELECT id, id AS node, x, y FROM own WHERE id NOT IN (SELECT u FROM first UNION SELECT u FROM second))"""
WIDTH = "width AS MATERIALIZED (SELECT pow(0.1 * pow(1 / 4.0, 1 / 6.0) * pow(count(*), -1 / 6.0) * least(stddev_pop(x), stddev_pop(y)), 2) AS sig FROM p2)"


def fitted(points: str, rounds: int, out: str, lam: float = 1.0) -> str:
    """out from a fit over the tree whose nodes are the points of points(id, x, y) without their outer two layers."""
    sig = "(SELECT sig FROM width)"
    return f"(WITH RECURSIVE own AS (SELECT 0 AS rep, id, x, y FROM {points}), {PEELED}, {fit('kept', 'kept', rounds, lam=f'({lam} / {sig})', sig=sig, alpha=0.0, ksig=7.0, steps=1500)} SELECT {out} FROM m{rounds})"


ORACLES["fit_points"] = f"{RECURSIVE}, {WIDTH}, model AS {fitted('p2', 2, '*')} SELECT node, round(x, 6) AS x, round(y, 6) AS y, round(sig, 6) AS sig, round(pi, 6) AS pi FROM model"
ORACLES["bootstrap_fit_nodes"] = f"""{RECURSIVE}, {WIDTH}, {sampled(3, "CAST(floor((SELECT count(*) FROM p2) * 0.75) AS BIGINT)")}
    SELECT CAST(rep AS INT) AS rep, node, round(x, 6) AS x, round(y, 6) AS y FROM ({' UNION ALL '.join(f"SELECT * FROM {fitted(f'(SELECT id, x, y FROM drawn WHERE rep = {r})', 2, f'{r} AS rep, node, x, y')}" for r in range(3))})"""
for _name in ("fit_by_tables", "fit_points_by_tables", "delaunay_graph_by_cells"):
    ORACLES[_name] = ORACLES[_name.rsplit("_by_", 1)[0]]
for _name in ("onion_layers_by_rounds", "tree_layers_by_rounds", "bootstrap_frequency_by_rounds", "fit_fixed_variance_by_passes", "fit_events_by_passes"):
    ORACLES[_name] = ORACLES[_name.rsplit("_by_", 1)[0]]

