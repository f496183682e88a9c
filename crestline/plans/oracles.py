"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from crestline.plans.fixtures import ALPHA, AREA, KSIG, SIG, ctes
from crestline.plans.oracles_graph import ORACLES as GRAPHS

DOWN = "(p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)"
PDF = f"pow(2 * pi() * s.sig, -1.0) * exp(-({DOWN}) / (2 * s.sig))"
GRAPH = ctes("p2", "near", "edges", "flat")
RESP = ctes("p2", "seeds", "resp")
SUMS = """sums AS (SELECT node, sum(r) AS n, sum(r * x) AS s_x, sum(r * y) AS s_y, sum(r * x * x) AS s_xx, sum(r * x * y) AS s_xy, sum(r * y * y) AS s_yy
    FROM resp JOIN p2 USING (id) WHERE node >= 0 GROUP BY node)"""
AROUND = """around AS (SELECT node, n, s_xx / n - 2 * s_x / n * s.x + s.x * s.x AS c_xx, s_xy / n - s_x / n * s.y - s_y / n * s.x + s.x * s.y AS c_xy,
    s_yy / n - 2 * s_y / n * s.y + s.y * s.y AS c_yy FROM sums JOIN seeds s USING (node))"""
LL = f"""ll AS (SELECT p.id, ln(sum(s.pi * {PDF})) AS ll FROM p2 p CROSS JOIN seeds s GROUP BY p.id)"""
ROUGH = "rough AS (SELECT sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS v FROM seeds a JOIN seeds b ON a.node > b.node)"
#: Proximity graph edges that hold the tree, small enough for the recursive walk.
RNG = """sides AS (SELECT a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p2 a JOIN p2 b ON a.id < b.id),
    rng AS (SELECT src, dst, d2 FROM sides e WHERE NOT EXISTS (SELECT 1 FROM p2 r, p2 a, p2 b WHERE a.id = e.src AND b.id = e.dst AND r.id <> e.src AND r.id <> e.dst
        AND (r.x - a.x) * (r.x - a.x) + (r.y - a.y) * (r.y - a.y) < e.d2 AND (r.x - b.x) * (r.x - b.x) + (r.y - b.y) * (r.y - b.y) < e.d2))"""
RNG_TREE = """ways AS (SELECT src AS u, dst AS v, src, dst, d2 FROM rng UNION ALL SELECT dst, src, src, dst, d2 FROM rng),
    grown AS (
        SELECT [(SELECT min(id) FROM p2)] AS seen, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst
        UNION ALL
        SELECT * FROM (SELECT list_append(g.seen, w.v), w.src, w.dst FROM grown g, ways w
            WHERE list_contains(g.seen, w.u) AND NOT list_contains(g.seen, w.v) ORDER BY w.d2, w.src, w.dst LIMIT 1)),
    tree AS (SELECT src, dst FROM grown WHERE src IS NOT NULL)"""
TREE_SQL = ctes("p2").replace("WITH ", "WITH RECURSIVE ") + f", {RNG}, {RNG_TREE}"
REACH = """reach(node, hops) AS (SELECT min(id), 0 FROM p2 UNION SELECT w.v, r.hops + 1 FROM reach r JOIN ways w ON w.u = r.node WHERE r.hops < 60)"""
CLOSURE = GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """, ways AS (SELECT src AS u, dst AS v FROM flat UNION SELECT dst, src FROM flat),
    linked(root, node) AS (SELECT id, id FROM p2 UNION SELECT l.root, w.v FROM linked l JOIN ways w ON w.u = l.node),
    found AS (SELECT node, min(root) AS comp FROM linked GROUP BY node)"""
T3 = "least(1.0, greatest(0.0, ((x - 1.0) * 49.0 + (y - 900.0) * 1100.0) / (49.0 * 49.0 + 1100.0 * 1100.0)))"


def gradient(value: str, axis: str, other: str) -> str:
    w = f"OVER (PARTITION BY {other} ORDER BY {axis})"
    return f"CASE WHEN lag({value}) {w} IS NULL THEN lead({value}) {w} - {value} WHEN lead({value}) {w} IS NULL THEN {value} - lag({value}) {w} ELSE (lead({value}) {w} - lag({value}) {w}) / 2 END"


ORACLES: dict[str, str] = {
    "bandwidth": f"""{ctes('parts')}, s AS (SELECT count(*) AS n, least(stddev_pop(x), stddev_pop(y)) AS m FROM parts),
        h AS (SELECT 0.1 * pow(1 / 4.0, 1 / 6.0) * pow(n, -1 / 6.0) * m AS h FROM s) SELECT round(h, 6) AS h, round(h * h, 6) AS sig FROM h""",
    "bounding_box": f"""{ctes('ev')} SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y,
        round(least(max(x) - min(x), max(y) - min(y)), 6) AS shortest FROM ev""",
    "summary": "SELECT round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min, count(value) AS n FROM events",
    "weighted_median": f"""{ctes('parts')}, c AS (SELECT y, x, sum(x) OVER (ORDER BY y, id) AS c, sum(x) OVER () / 2 AS half FROM parts)
        SELECT round(CASE WHEN max(x) > max(half) THEN arg_max(y, x) WHEN count(*) FILTER (c = half) > 0 THEN (max(y) FILTER (c = half) + min(y) FILTER (c > half)) / 2
        ELSE min(y) FILTER (c > half) END, 6) AS median FROM c""",
    "density_map": f"""{ctes('ev')}, b AS (SELECT min(x) - 1 AS x0, (max(x) + 1 - (min(x) - 1)) / 64 AS dx, min(y) - 1 AS y0, (max(y) + 1 - (min(y) - 1)) / 48 AS dy FROM ev)
        SELECT CAST(greatest(0, least(63, round_even((x - x0) / dx, 0))) AS BIGINT) AS ix, CAST(greatest(0, least(47, round_even((y - y0) / dy, 0))) AS BIGINT) AS iy,
        round(count(*) / any_value(dx) / any_value(dy), 6) AS density FROM ev, b GROUP BY 1, 2""",
    "grid_hessian": f"""WITH v AS (SELECT CAST(l_quantity AS BIGINT) AS ix, CAST(l_linenumber AS BIGINT) AS iy, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
        g AS (SELECT *, {gradient('v', 'ix', 'iy')} AS g_ix, {gradient('v', 'iy', 'ix')} AS g_iy FROM v)
        SELECT ix, iy, round(v, 6) AS v, round(g_ix, 6) AS g_ix, round(g_iy, 6) AS g_iy, round({gradient('g_ix', 'ix', 'iy')}, 6) AS h_ix_ix, round({gradient('g_ix', 'iy', 'ix')}, 6) AS h_ix_iy,
        round({gradient('g_iy', 'ix', 'iy')}, 6) AS h_iy_ix, round({gradient('g_iy', 'iy', 'ix')}, 6) AS h_iy_iy FROM g""",
    "short_numbers": "SELECT p_partkey AS id, CAST(round(CAST(p_retailprice AS DOUBLE), 1) AS VARCHAR) AS short FROM part",
    "vector_algebra": f"""{ctes('p3')} SELECT id, round(x * y + y * z + z * x, 6) AS dot, round(sqrt(x * x + y * y + z * z), 6) AS length,
        round(sqrt((y - x) * (y - x) + (z - y) * (z - y) + (x - z) * (x - z)), 6) AS distance, round(x / sqrt(x * x + y * y + z * z), 6) AS unit_x, round(y - x, 6) AS step_x, round(z + 2 * x, 6) AS sum_z FROM p3""",
    "segment_distance": f"""{ctes('parts')}, f AS (SELECT id, x, y, 1.0 + 49.0 * {T3} AS fx, 900.0 + 1100.0 * {T3} AS fy FROM parts)
        SELECT id, round(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)), 6) AS dist, round(fx, 6) AS foot_x, round(fy, 6) AS foot_y FROM f""",
    "eigenvalues_2d": """WITH c AS (SELECT l_suppkey, var_samp(l_quantity) AS a, var_samp(l_discount) AS b, covar_samp(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1),
        e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS e1, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c) AS e2 FROM c)
        SELECT l_suppkey, round(e1, 6) AS e1, round(e2, 6) AS e2, round(sqrt(-2 * ln(0.1) * e1), 6) AS long_axis, round(sqrt(-2 * ln(0.1) * greatest(e2, 0)), 6) AS short_axis, round(atan2(e1 - a, c), 6) AS angle FROM e""",
    "eigenvalues_3d": """WITH r AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
        c AS (SELECT label, var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM r GROUP BY 1),
        q AS (SELECT *, (a + b + c) / 3 AS q FROM c), p AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
        r2 AS (SELECT *, ((a - q) * (b - q) * (c - q) + 2 * d * f * e - e * e * (b - q) - d * d * (c - q) - f * f * (a - q)) / (2 * p * p * p) AS r FROM p),
        z AS (SELECT label, q, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3) AS e1, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3) AS e3 FROM r2)
        SELECT label, round(e1, 6) AS e1, round(3 * q - e1 - e3, 6) AS e2, round(e3, 6) AS e3 FROM z""",
    "range_join": f"{ctes('p2', 'seeds')} SELECT p.id, s.node, round({DOWN}, 6) AS d2 FROM p2 p JOIN seeds s ON {DOWN} <= 0.05::DOUBLE * 0.05::DOUBLE",
    "knn": f"{ctes('p2', 'near')} SELECT src, dst, CAST(rank AS INT) AS rank, round(d2, 6) AS d2 FROM ranked WHERE rank <= 5",
    "knn_graph": f"{ctes('p2', 'near')} SELECT src, dst FROM ranked WHERE rank <= 9",
    "reciprocal_knn_graph": f"{ctes('p2', 'near')} SELECT a.src, a.dst FROM ranked a JOIN ranked b ON a.src = b.dst AND a.dst = b.src WHERE a.rank <= 14 AND b.rank <= 14",
    "fixed_length_graph": f"{ctes('p2', 'near')} SELECT src, dst FROM ranked WHERE d2 <= 0.02::DOUBLE * 0.02::DOUBLE",
    "sphere_of_influence": f"""{ctes('p2', 'near')}, least AS (SELECT src, dst, d2, sqrt(min(d2) OVER (PARTITION BY src)) * 2 AS reach FROM ranked)
        SELECT src, dst FROM least WHERE d2 > 0 AND d2 < reach * reach""",
    "gradient_graph": f"""{ctes('p2', 'near')}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY CAST(embedding[3] AS DOUBLE) DESC, rank) AS o
        FROM ranked JOIN embeddings ON vec_id = dst WHERE rank <= 9) SELECT src, dst FROM o WHERE o <= 3""",
    "full_graph": f"{ctes('seeds')} SELECT a.node AS src, b.node AS dst FROM seeds a JOIN seeds b ON a.node > b.node",
    "relative_neighbours": f"{ctes('p2')}, {RNG} SELECT src, dst FROM rng",
    "mst": f"{TREE_SQL} SELECT src, dst FROM tree",
    "mst_by_rounds": f"{TREE_SQL} SELECT src, dst FROM tree",
    "neighbour_lists": f"{GRAPH} SELECT src, dst FROM flat UNION ALL SELECT dst, src FROM flat",
    "edge_weights": f"{GRAPH} SELECT src, dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS w FROM edges JOIN p2 a ON a.id = src JOIN p2 b ON b.id = dst",
    "numbered_edges": f"{GRAPH} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst FROM flat",
    "adjacency": f"{GRAPH} SELECT \"row\", col, sum(1.0::DOUBLE) AS val FROM (SELECT src AS \"row\", dst AS col FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY 1, 2",
    "adjacency_dense": f"{GRAPH} SELECT src AS \"row\", dst AS col, 1.0::DOUBLE AS val FROM flat UNION ALL SELECT dst, src, 1.0::DOUBLE FROM flat",
    "degree": f"{GRAPH}, ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT id AS node, count(ends.node) AS deg FROM p2 LEFT JOIN ends ON ends.node = id GROUP BY id",
    "laplacian": f"""{GRAPH}, ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)
        SELECT a AS "row", b AS col, -CAST(count(*) AS DOUBLE) AS val FROM ways GROUP BY 1, 2 UNION ALL SELECT a, a, CAST(count(*) AS DOUBLE) FROM ways GROUP BY a""",
    "edge_lines": f"{GRAPH} SELECT src, dst, round(a.x, 6) AS x0, round(b.x, 6) AS x1, round(a.y, 6) AS y0, round(b.y, 6) AS y1, CAST(3 AS INT) AS n FROM edges JOIN p2 a ON a.id = src JOIN p2 b ON b.id = dst",
    "components": f"{CLOSURE} SELECT node, comp FROM found",
    "giant_component": f"""{CLOSURE}, best AS (SELECT comp FROM found GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1) SELECT node, CAST(comp = (SELECT comp FROM best) AS INT) AS in_giant FROM found""",
    "hop_distances": f"""{GRAPH.replace('WITH ', 'WITH RECURSIVE ', 1)}, ways AS (SELECT src AS u, dst AS v FROM flat UNION SELECT dst, src FROM flat), {REACH}
        SELECT (SELECT min(id) FROM p2) AS source, node, CAST(min(hops) AS INT) AS hops FROM reach GROUP BY node""",
    "edge_numbers": f"""{GRAPH}, n AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src AS a, dst AS b FROM flat)
        SELECT src, dst, edge_id FROM edges JOIN n ON a = least(src, dst) AND b = greatest(src, dst)""",
    "shortest_path": f"""{TREE_SQL}, step(path) AS (SELECT [(SELECT min(id) FROM p2)] UNION ALL SELECT list_append(path, t.v) FROM step JOIN
        (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree) t ON t.u = path[-1] WHERE NOT list_contains(path, t.v) AND path[-1] <> (SELECT max(id) FROM p2)),
        found AS (SELECT path FROM step WHERE path[-1] = (SELECT max(id) FROM p2))
        SELECT CAST(i AS INT) AS step, CAST(path[i + 1] AS BIGINT) AS node FROM found, unnest(range(0, len(path))) t(i)""",
    "path_lengths": f"""{TREE_SQL}, step(node, prior, hops, len) AS (SELECT (SELECT min(id) FROM p2), CAST(-1 AS BIGINT), 0, 0.0::DOUBLE UNION ALL
        SELECT t.v, s.node, s.hops + 1, s.len + sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FROM step s JOIN
        (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree) t ON t.u = s.node AND t.v <> s.prior JOIN p2 a ON a.id = t.u JOIN p2 b ON b.id = t.v)
        SELECT (SELECT min(id) FROM p2) AS source, node, CAST(hops AS INT) AS hops, round(len, 6) AS len FROM step""",
    "e_step": f"{RESP} SELECT id, node, round(r, 6) AS r FROM resp_plain",
    "e_step_background": f"{RESP} SELECT id, node, round(r, 6) AS r FROM resp",
    "row_normalise": "SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE) / (1 + sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey)), 6) AS share FROM lineitem",
    "softmax_responsibility": f"{ctes('p2', 'seeds')}, e AS (SELECT p.id, s.node, exp(-({DOWN}) / (2 * s.sig)) AS e FROM p2 p, seeds s) SELECT id, node, round(e / sum(e) OVER (PARTITION BY id), 6) AS r FROM e",
    "densities": f"{ctes('p2', 'seeds')} SELECT p.id, s.node, round({PDF}, 6) AS p FROM p2 p, seeds s",
    "node_sums": f"{RESP}, {SUMS} SELECT node, round(n, 6) AS n, round(s_x, 6) AS s_x, round(s_y, 6) AS s_y, round(s_xx, 6) AS s_xx, round(s_xy, 6) AS s_xy, round(s_yy, 6) AS s_yy FROM sums",
    "weighted_covariance": f"{RESP}, {SUMS}, {AROUND} SELECT node, round(n, 6) AS n, round(c_xx, 6) AS c_xx, round(c_xy, 6) AS c_xy, round(c_yy, 6) AS c_yy FROM around",
    "weighted_covariance_3d": f"""{ctes('p3', 'seeds3')}, w AS (SELECT p.id, s.node, s.pi * pow(2 * pi() * s.sig, -1.5) * exp(-({DOWN} + (p.z - s.z) * (p.z - s.z)) / (2 * s.sig)) AS w, p.x - s.x AS x, p.y - s.y AS y, p.z - s.z AS z
        FROM p3 p JOIN seeds s ON {DOWN} + (p.z - s.z) * (p.z - s.z) <= {KSIG} * {KSIG} * s.sig), r AS (SELECT *, w / sum(w) OVER (PARTITION BY id) AS r FROM w)
        SELECT node, round(sum(r * x * x) / sum(r), 6) AS c_xx, round(sum(r * x * y) / sum(r), 6) AS c_xy, round(sum(r * x * z) / sum(r), 6) AS c_xz, round(sum(r * y * y) / sum(r), 6) AS c_yy,
        round(sum(r * y * z) / sum(r), 6) AS c_yz, round(sum(r * z * z) / sum(r), 6) AS c_zz FROM r GROUP BY node""",
    "mixture_update": f"{RESP}, {SUMS}, {AROUND} SELECT node, round(n, 6) AS n, round((c_xx + c_yy) / 2, 6) AS sig, round(n / (SELECT count(*) FROM p2), 6) AS pi FROM around",
    "background_share": f"{RESP} SELECT round(sum(r) / (SELECT count(*) FROM p2), 6) AS alpha FROM resp WHERE node = -1",
    "smoothed_variance": f"""{RESP}, {SUMS}, {AROUND} SELECT node, round(((c_xx + c_yy) / 2 + 10 / n * {SIG}) / (1 + 10 / n), 6) AS sig FROM around""",
    "log_likelihood": f"{ctes('p2', 'seeds')}, {LL} SELECT round(sum(ll), 4) AS ll FROM ll",
    "objective": f"""{ctes('p2', 'seeds')}, l AS (SELECT p.id, ln(sum(s.pi * {PDF}) + {ALPHA / AREA}) AS ll FROM p2 p CROSS JOIN seeds s GROUP BY p.id), {ROUGH}
        SELECT round(sum(ll) - (SELECT v FROM rough), 4) AS objective FROM l""",
    "local_objective": f"""{ctes('p2', 'seeds')}, {LL} SELECT s.node, round(sum(pow(2 * pi(), -1.0) * exp(-({DOWN}) / 2) * ll), 4) AS value FROM p2 p JOIN ll USING (id) CROSS JOIN seeds s GROUP BY s.node""",
    "mixture_density": f"""{ctes('p2', 'seeds')}, d AS (SELECT p.id, sum(s.pi * {PDF}) AS d FROM p2 p CROSS JOIN seeds s GROUP BY p.id)
        SELECT id, round(d / sum(d) OVER () * (SELECT count(*) FROM seeds), 6) AS density FROM d""",
    "neighbour_covariance": f"""{ctes('p2', 'seeds')}, k AS (SELECT s.node, p.x, p.y, row_number() OVER (PARTITION BY s.node ORDER BY (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y), p.id) AS rank FROM seeds s, p2 p)
        SELECT node, count(*) AS n, round(var_samp(x), 6) AS c_xx, round(covar_samp(x, y), 6) AS c_xy, round(var_samp(y), 6) AS c_yy FROM k WHERE rank <= 20 GROUP BY node""",
    "in_pattern": f"""{RESP}, t AS (SELECT id, coalesce(sum(r) FILTER (node >= 0), 0) AS i, coalesce(max(r) FILTER (node = -1), 0) AS o FROM resp GROUP BY id)
        SELECT id, CAST(i > 0 AND o <= i AS INT) AS inside FROM t""",
    "skeleton_distance": f"""{ctes('p2', 'seeds')}, k AS (SELECT p.id, s.node, row_number() OVER (PARTITION BY p.id ORDER BY {DOWN}, s.node) AS rank FROM p2 p, seeds s),
        e AS (SELECT a.node AS src, b.node AS dst, a.x AS ax, a.y AS ay, b.x - a.x AS vx, b.y - a.y AS vy FROM seeds a JOIN seeds b ON a.node < b.node),
        t AS (SELECT k.id, e.*, greatest(0.0, least(1.0, ((p.x - ax) * vx + (p.y - ay) * vy) / (vx * vx + vy * vy))) AS t, p.x, p.y FROM k JOIN e ON k.node = e.src OR k.node = e.dst JOIN p2 p ON p.id = k.id WHERE k.rank <= 10)
        SELECT id, round(min(sqrt(pow(x - ax - t * vx, 2) + pow(y - ay - t * vy, 2))), 6) AS distance FROM t GROUP BY id""",
    "subsamples": """WITH r AS (SELECT CAST(rep AS INT) AS rep, vec_id AS node, row_number() OVER (PARTITION BY rep ORDER BY md5('0|' || rep || '|' || vec_id), vec_id) AS p FROM embeddings, range(5) t(rep))
        SELECT rep, node FROM r WHERE p <= 100""",
    "edge_samples": f"""{GRAPH}, s AS (SELECT src, dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / 0.005::DOUBLE AS n FROM edges JOIN p2 a ON a.id = src JOIN p2 b ON b.id = dst)
        SELECT src, dst, round(ax + k / n * (bx - ax), 6) AS x, round(ay + k / n * (by_ - ay), 6) AS y FROM s, unnest(range(0, CAST(floor(n) AS BIGINT) + 1)) t(k) UNION ALL SELECT src, dst, round(bx, 6), round(by_, 6) FROM s""",
    "full_covariance_e_step": f"""{ctes('p2', 'seeds')}, k AS (SELECT s.node, p.x, p.y, row_number() OVER (PARTITION BY s.node ORDER BY (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y), p.id) AS rank FROM seeds s, p2 p),
        c AS (SELECT node, var_samp(x) AS a, covar_samp(x, y) AS c, var_samp(y) AS b FROM k WHERE rank <= 20 GROUP BY node),
        q AS (SELECT p.id, s.node, exp(-((c.b * (p.x - s.x) * (p.x - s.x) - 2 * c.c * (p.x - s.x) * (p.y - s.y) + c.a * (p.y - s.y) * (p.y - s.y)) / (c.a * c.b - c.c * c.c)) / 2) / sqrt(c.a * c.b - c.c * c.c) AS w
        FROM p2 p CROSS JOIN seeds s JOIN c USING (node)), l AS (SELECT id, node, w, sum(w) OVER (PARTITION BY id) AS t FROM q)
        SELECT id, node, round(w / t, 6) AS r FROM l""",
    "position_uncertainty": f"""{ctes('p2', 'seeds')}, r AS (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY md5('0|' || rep || '|' || id), id) AS p FROM p2, range(10) t(rep)),
        d AS (SELECT r.rep, s.node, min({DOWN}) AS d2 FROM r JOIN p2 p ON p.id = r.id CROSS JOIN seeds s WHERE r.p <= CAST(floor((SELECT count(*) FROM p2) * 0.75) AS BIGINT) GROUP BY r.rep, s.node)
        SELECT node, round(sqrt(avg(d2)), 6) AS rho FROM d GROUP BY node""",
    "probability_map": f"""{GRAPH}, r AS (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY md5('0|' || rep || '|' || id), id) AS p FROM p2, range(10) t(rep)),
        k AS (SELECT rep, id FROM r WHERE p <= CAST(floor((SELECT count(*) FROM p2) * 0.75) AS BIGINT)),
        b AS (SELECT min(x) AS x0, (max(x) - min(x)) / 32 AS sx, min(y) AS y0, (max(y) - min(y)) / 32 AS sy, least(max(x) - min(x), max(y) - min(y)) / 32 / 5 AS step FROM p2),
        s AS (SELECT u.rep, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / (SELECT step FROM b) AS n
            FROM flat JOIN k u ON u.id = src JOIN k v ON v.id = dst AND v.rep = u.rep JOIN p2 a ON a.id = src JOIN p2 b ON b.id = dst),
        q AS (SELECT rep, ax + k / n * (bx - ax) AS x, ay + k / n * (by_ - ay) AS y FROM s, unnest(range(0, CAST(floor(n) AS BIGINT) + 1)) t(k) UNION ALL SELECT rep, bx, by_ FROM s),
        c AS (SELECT DISTINCT rep, CAST(CASE WHEN x = x0 + 31 * sx THEN 30 ELSE floor((x - x0) / sx) END AS BIGINT) AS i_x, CAST(CASE WHEN y = y0 + 31 * sy THEN 30 ELSE floor((y - y0) / sy) END AS BIGINT) AS i_y FROM q, b)
        SELECT i_x, i_y, round(count(*) / 10.0::DOUBLE, 6) AS p FROM c WHERE i_x BETWEEN 0 AND 30 AND i_y BETWEEN 0 AND 30 GROUP BY 1, 2""",
    "find_filaments": f"""{TREE_SQL}, way AS (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree),
        far AS (SELECT u, v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM way JOIN p2 a ON a.id = u JOIN p2 b ON b.id = v),
        deg AS (SELECT u AS node, count(*) AS d FROM way GROUP BY u),
        walk(path, len) AS (SELECT [u, v], w FROM far JOIN deg ON node = u WHERE d <> 2 UNION ALL
            SELECT list_append(path, f.v), len + f.w FROM walk JOIN deg ON deg.node = path[-1] AND deg.d = 2 JOIN far f ON f.u = path[-1] AND f.v <> path[-2]),
        ended AS (SELECT path, len, a.d AS d1, b.d AS d2 FROM walk JOIN deg a ON a.node = path[1] JOIN deg b ON b.node = path[-1] AND b.d <> 2),
        kept AS (SELECT path, len, CASE WHEN d1 > 1 THEN 3 WHEN d2 > 1 THEN 2 ELSE 1 END AS type FROM ended WHERE (d1 = 1 AND d2 > 1) OR ((d1 = 1) = (d2 = 1) AND path[1] < path[-1]))
        SELECT row_number() OVER (ORDER BY type = 3, path) - 1 AS fil_id, CAST(type AS INT) AS type, round(len, 6) AS length,
        round(1 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / len, 6) AS curvature, list_aggregate(path, 'string_agg', ',') AS path FROM kept JOIN p2 a ON a.id = path[1] JOIN p2 b ON b.id = path[-1]""",
    "short_branches_cut": f"""{TREE_SQL}, way AS (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree), deg AS (SELECT u AS node, count(*) AS d FROM way GROUP BY u),
        walk(path) AS (SELECT [u, v] FROM way JOIN deg ON node = u WHERE d = 1 UNION ALL SELECT list_append(path, v) FROM walk JOIN deg ON deg.node = path[-1] AND deg.d = 2 JOIN way ON u = path[-1] AND v <> path[-2]),
        gone AS (SELECT unnest(path[1 : len(path) - 1]) AS node FROM walk JOIN deg ON deg.node = path[-1] AND deg.d > 2 WHERE len(path) - 1 <= 3)
        SELECT id AS node FROM p2 WHERE id NOT IN (SELECT node FROM gone)""",
    "pruned_nodes": f"""{TREE_SQL}, way AS (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree), leaf AS (SELECT u FROM way GROUP BY u HAVING count(*) = 1),
        second AS (SELECT u FROM way WHERE u NOT IN (SELECT u FROM leaf) AND v NOT IN (SELECT u FROM leaf) GROUP BY u HAVING count(*) = 1)
        SELECT id AS node FROM p2 WHERE id NOT IN (SELECT u FROM leaf) AND id NOT IN (SELECT u FROM second)""",
    "connectivity_events": f"""{TREE_SQL}, way AS (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree), deg AS (SELECT u AS node, count(*) AS d FROM way GROUP BY u),
        home AS (SELECT id AS c, x AS cx, y AS cy FROM p2 ORDER BY x * x + y * y, id LIMIT 1),
        far AS (SELECT id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS e FROM p2, home),
        walk(node, prior, len) AS (SELECT c, CAST(-1 AS BIGINT), 0.0::DOUBLE FROM home UNION ALL
            SELECT way.v, w.node, w.len + sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FROM walk w JOIN way ON way.u = w.node AND way.v <> w.prior JOIN p2 a ON a.id = way.u JOIN p2 b ON b.id = way.v
            JOIN far ON far.id = way.v AND far.e < 0.1::DOUBLE),
        ev AS (SELECT node, CASE WHEN node = (SELECT c FROM home) THEN d WHEN d = 1 THEN -1 WHEN d > 2 THEN d - 2 END AS event, e, len FROM walk JOIN deg USING (node) JOIN far ON far.id = node)
        SELECT node, CAST(event AS INT) AS event, round(e, 6) AS euclidean, round(len, 6) AS geodesic, CAST(sum(event) OVER (ORDER BY e, node) AS BIGINT) AS connectivity FROM ev WHERE event IS NOT NULL""",
    "graph_diameter": f"""{TREE_SQL},
        hop(root, node, prior, hops) AS (SELECT id, id, CAST(-1 AS BIGINT), 0 FROM p2 UNION ALL SELECT h.root, t.v, h.node, h.hops + 1 FROM hop h JOIN (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree) t ON t.u = h.node AND t.v <> h.prior)
        SELECT CAST(max(hops) AS BIGINT) AS diameter FROM hop""",
    "remove_short_edges": f"""{TREE_SQL}, long AS (SELECT src, dst FROM tree JOIN p2 a ON a.id = src JOIN p2 b ON b.id = dst WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) >= 0.01::DOUBLE),
        left2 AS (SELECT * FROM p2 WHERE id IN (SELECT src FROM long UNION SELECT dst FROM long)), {(RNG + ', ' + RNG_TREE).replace('p2', 'left2').replace('sides', 'sides2').replace('rng', 'rng2').replace('ways', 'ways2').replace('grown', 'grown2').replace('tree AS', 'tree2 AS')}
        SELECT src, dst FROM tree2""",
    "ellipsoid_graph": f"""{ctes('p2')}, ball AS (SELECT a.id AS src, b.id AS dst, b.x, b.y, b.x - a.x AS dx, b.y - a.y AS dy FROM p2 a JOIN p2 b ON a.id = b.id OR ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) > 0
        AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) < 0.05::DOUBLE * 0.05::DOUBLE)),
        c AS (SELECT src, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM ball GROUP BY src HAVING count(*) > 15),
        e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS l1, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c) AS l2 FROM c),
        s AS (SELECT src, 0.05::DOUBLE * sqrt(l1 / l2) AS big, 0.05::DOUBLE / sqrt(l1 / l2) AS small, c / sqrt(c * c + (l2 - a) * (l2 - a)) AS ux, (l2 - a) / sqrt(c * c + (l2 - a) * (l2 - a)) AS uy FROM e WHERE l2 > 0)
        SELECT src, dst FROM ball WHERE src <> dst AND src NOT IN (SELECT src FROM s) UNION ALL
        SELECT p.id, o.id FROM s JOIN p2 p ON p.id = s.src JOIN p2 o ON o.id <> p.id WHERE pow(((o.x - p.x) * ux + (o.y - p.y) * uy) / small, 2) + pow(((o.x - p.x) * uy - (o.y - p.y) * ux) / big, 2) <= 1""",
    "edge_text_round_trip": f"{GRAPH} SELECT src, dst FROM edges",
}

ORACLES |= GRAPHS

ORACLES["e_step_by_join"] = ORACLES["e_step_background"]
ORACLES["ends_and_loops"] = ORACLES["find_filaments"].replace("SELECT row_number()", "SELECT fil_id, type, length FROM (SELECT row_number()") + ") WHERE type <> 3"
ORACLES["path_lengths_by_rounds"] = f"""{GRAPH.replace('WITH ', 'WITH RECURSIVE ', 1)}, ways AS MATERIALIZED (SELECT u, v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM (SELECT src AS u, dst AS v FROM flat UNION SELECT dst, src FROM flat) JOIN p2 a ON a.id = u JOIN p2 b ON b.id = v),
    step(node, hops, len) AS (SELECT min(id), 0, 0.0::DOUBLE FROM p2 UNION ALL SELECT v, hops + 1, min(len + w) FROM step JOIN ways ON u = node WHERE hops < 200 GROUP BY v, hops),
    first AS (SELECT node, min(hops) AS hops, arg_min(len, hops) AS len FROM step GROUP BY node) SELECT (SELECT min(id) FROM p2) AS source, node, CAST(hops AS INT) AS hops, round(len, 6) AS len FROM first"""
for _name in ("position_uncertainty_by_cells", "knn_by_cells", "sphere_of_influence_by_cells", "relative_neighbours_by_cells", "numbered_edges_by_rounds", "components_by_rounds", "hop_distances_by_rounds", "find_filaments_by_rounds"):
    ORACLES[_name] = ORACLES[_name.rsplit("_by_", 1)[0]]

