"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from crestline.llm.chat import CONTROLS, END, ESCAPE, SEP, START

#: op2: exact Jaccard links of all pairs that share a shingle, and components by following links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
runs AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS s FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v, s.n = a.n AND s.n = b.n AS same FROM shared s JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE s.n >= 0.8 * (a.n + b.n - s.n) - 1e-9),
reach(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.root, l.v FROM reach r JOIN links l ON l.u = r.node),
classes AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node)
SELECT c.doc_id, c.class_id, count(l.v) AS n_links, 1 + count(l.v) FILTER (l.same) AS n_copies FROM classes c LEFT JOIN links l ON l.u = c.doc_id GROUP BY c.doc_id, c.class_id
"""


def _escaped(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        text = f"replace({text}, '{c}', '{c[0]}{ESCAPE}{c[1:]}')"
    return text


#: op5: the digests from the turns themselves, and the length of all examples.
CHATS = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(START) + len(SEP) + len(END)} + length({_escaped('role')}) + length({_escaped('text')})) OVER w AS upto
    FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def mix(weights: dict[str, int], default: int, cells: int = 4096) -> str:
    """op8 with blocks of one row: earliest deadline first, slot by slot, in each kind of frame."""
    case = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END"
    return f"""
WITH RECURSIVE ranked AS (SELECT doc_id, source, CAST({case} AS BIGINT) AS weight, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {cells}, doc_id) - 1 AS block FROM documents),
supply AS (SELECT source, any_value(weight) AS w, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM ranked GROUP BY source),
edges AS (SELECT 0 AS e UNION SELECT n // w FROM supply UNION SELECT (n + w - 1) // w FROM supply),
kinds AS (SELECT * FROM (SELECT e AS a, lead(e) OVER (ORDER BY e) AS b FROM edges) WHERE b IS NOT NULL),
shares AS (SELECT a, b, i, source, greatest(0, least(w, n - w * a)) AS m FROM kinds, supply),
frames AS (SELECT a, b, list(m ORDER BY i) AS ms, CAST(sum(m) AS BIGINT) AS width FROM shares GROUP BY a, b),
starts AS (SELECT *, coalesce(sum(width * (b - a)) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM frames WHERE width > 0),
run AS (
    SELECT a, CAST(0 AS BIGINT) AS t, list_transform(ms, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS k FROM starts
    UNION ALL
    SELECT a, t + 1, list_transform(done, lambda x, j: CASE WHEN j = best.i THEN x + 1 ELSE x END), best.i, done[best.i] FROM (
        SELECT r.a, r.t, r.done, list_min(list_transform(list_filter(range(1, len(s.ms) + 1), lambda i: r.done[i] < s.ms[i] AND r.done[i] * s.width < (r.t + 1) * s.ms[i]),
            lambda i: {{'d': ((r.done[i] + 1) * s.width + s.ms[i] - 1) // s.ms[i], 'i': i}})) AS best
        FROM run r JOIN starts s ON s.a = r.a WHERE r.t < s.width)),
slots AS (SELECT r.a, s.b, s.start, s.width, p.source, r.k, r.t - 1 AS place, (r.k * s.width) // s.ms[r.pick] AS rel, ((r.k + 1) * s.width + s.ms[r.pick] - 1) // s.ms[r.pick] AS due
    FROM run r JOIN starts s ON s.a = r.a JOIN supply p ON p.i = r.pick WHERE r.pick IS NOT NULL)
SELECT d.doc_id, d.source, d.weight, CAST(d.block AS BIGINT) AS block, CAST(start + (d.block // d.weight - a) * width + place AS BIGINT) AS slot, CAST(start + (d.block // d.weight - a) * width + rel AS BIGINT) AS release,
    CAST(start + (d.block // d.weight - a) * width + due AS BIGINT) AS deadline, CAST(start + (d.block // d.weight - a) * width + place AS BIGINT) AS position
FROM ranked d JOIN slots s ON s.source IS NOT DISTINCT FROM d.source AND s.k = d.block % d.weight AND d.block // d.weight >= s.a AND d.block // d.weight < s.b
"""


#: op11: shares of all kept terms in every group, and sums over all of them.
DIVERGENCE = r"""
WITH said AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
uses AS (SELECT lang, source, r, unnest(w) AS term FROM said),
kept AS (SELECT lang, term, count(*) AS n FROM uses GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
pools AS (SELECT DISTINCT lang, source FROM said),
own AS (SELECT u.lang, u.source, u.term, count(*) AS n FROM uses u JOIN kept k ON k.lang = u.lang AND k.term = u.term GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0)::BIGINT AS n FROM pools g LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source GROUP BY ALL),
shares AS (SELECT k.lang, t.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000::BIGINT * (coalesce(o.n, 0) + 2) // (t.n + 2 * l.v) AS p, 1 + 1000000000::BIGINT * (k.n + 2) // (l.n + 2 * l.v) AS q
    FROM kept k JOIN langs l ON l.lang = k.lang JOIN totals t ON t.lang = k.lang LEFT JOIN own o ON o.lang = k.lang AND o.term = k.term AND o.source = t.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM pools a JOIN pools b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found QUALIFY part = 'pair' OR rank <= 10
"""
