"""Maximum inner product search with score-aware anisotropic quantisation.

Vectors fall into lists around centres; what is left of a vector is coded with four bits for
each pair of dimensions. Codes and codebooks minimise a loss in which the error parallel to the vector
counts more than the rest of it, as that error moves large inner products. A query's
table holds its product with every code; a scan adds up table entries for all codes of
a list, and the best of each chunk are scored exactly on the original vectors: `rerank` at least, up to four times as many where the
scan needs them to hold `recall` of the true neighbours within the sample.

Centres and codebooks are fitted on a sample of at most `most_sample` vectors (those
with the smallest hash); every vector is coded. A query visits the least number of lists that holds `recall` of the true neighbours within the sample, and
goes on until those it visits hold k candidates.

What is fitted on a sample need not suit the queries, so bounds decide what may be left out. The kth best of a part of the sample is a score that a
neighbour has at least. A query visits every list whose centre and radius allow that score. In a chunk, the sum of the table entries and the length
of a row's coding error bound its score; every row that may reach the kth best known is scored exactly. So no neighbour is lost, whatever the rows;
vectors without clusters are scanned whole. Lists beyond `chunk_bytes` of vectors are scanned in chunks; queries visit each
chunk as rows, so nothing grows on the driver or in a broadcast. A task keeps the k best of each query over all chunks that it scans,
and sends these on.

Defined results: a vector that is null or zero, holds a null or non-finite component, or differs
from the commonest number of dimensions takes no part, nor does a row without id;
candidates are all rows but those of the query's own id; repeated rows are candidates each; ties go
to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODES = 16
#: More than sums of double precision are off, as a part of the lengths of both vectors.
ROUNDING = 1e-11
#: Components of the part of the sample that goes along for a first bound.
KNOWN = 500_000


@dataclass(frozen=True)
class Quantiser:
    """centres: lists by dimensions; books: pairs of dimensions by 16 by 2; probes: lists that a query visits at least; share: of a list's rows, for a first choice."""

    centres: np.ndarray
    books: np.ndarray
    weight: float
    probes: int
    share: float

    def lists(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)


def paired(x: np.ndarray) -> np.ndarray:
    """Dimensions as pairs, an odd last one with a zero."""
    if x.shape[1] % 2:
        x = np.concatenate((x, np.zeros((len(x), 1))), 1)
    return x.reshape(len(x), -1, 2)


def encode(rest: np.ndarray, direction: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2, rows: int = 1024) -> np.ndarray:
    """Codes of rest (pairs) by coordinate descent on squared error + weight * squared error along direction, rows vectors at a time."""
    parts = [_encode(rest[a : a + rows], direction[a : a + rows], books, weight, sweeps) for a in range(0, len(rest), rows)]
    return np.concatenate(parts) if parts else np.zeros(rest.shape[:2], np.int64)


def _encode(rest: np.ndarray, direction: np.ndarray, books: np.ndarray, weight: float, sweeps: int) -> np.ndarray:
    gaps = ((rest[:, :, None, :] - books[None]) ** 2).sum(3)
    along = ((rest[:, :, None, :] - books[None]) * direction[:, :, None, :]).sum(3)
    codes = gaps.argmin(2)
    rows = np.arange(len(rest))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(rest.shape[1]):
            others = total - along[rows, m, codes[:, m]]
            codes[:, m] = (gaps[:, m] + weight * (others[:, None] + along[:, m]) ** 2).argmin(1)
            total = others + along[rows, m, codes[:, m]]
    return codes


def fit_arrays(x: np.ndarray, n_lists: int, *, k: int = 20, recall: float = 0.98, threshold: float = 0.2, rounds: int = 8, seed: int = 3) -> Quantiser:
    """Centres by k-means, codebooks by alternating coding and weighted least squares."""
    draw = np.random.default_rng(seed)
    n, dims = x.shape
    n_lists = min(n_lists, n)
    # first centres far from each other: each is drawn by squared distance from those before
    far, first = np.full(n, np.inf), [int(draw.integers(n))]
    while len(first) < n_lists:
        far = np.minimum(far, ((x - x[first[-1]]) ** 2).sum(1))
        first.append(int(draw.choice(n, p=far / far.sum())) if far.sum() > 0 else len(first) % n)
    centres = x[first].copy()
    for _ in range(rounds):
        at = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=n_lists)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    weight = max(0.0, (dims - 1) * threshold**2 / (1 - threshold**2) - 1)
    at = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
    rest = paired(x - centres[at])
    direction = paired(x / np.linalg.norm(x, axis=1, keepdims=True))
    books = np.stack([rest[draw.choice(n, CODES, n < CODES), m] for m in range(rest.shape[1])])
    for _ in range(rounds):
        codes = encode(rest, direction, books, weight, 1)
        rows = np.arange(n)
        error = rest - books[np.arange(rest.shape[1]), codes]
        along = (error * direction).sum(2)
        total = along.sum(1)
        for m in range(rest.shape[1]):
            u, others = direction[:, m], total - along[:, m]
            aim = others + (rest[:, m] * u).sum(1)
            for c in range(CODES):
                own = rows[codes[:, m] == c]
                if len(own):
                    left = len(own) * np.eye(2) + weight * u[own].T @ u[own]
                    right = rest[own, m].sum(0) + weight * (aim[own, None] * u[own]).sum(0)
                    books[m, c] = np.linalg.solve(left, right)
            new = ((rest[:, m] - books[m, codes[:, m]]) * u).sum(1)
            total, along[:, m] = others + new, new
    chosen = draw.choice(n, min(n, 256), False)
    asked = x[chosen]
    products = asked @ x.T
    # of vectors of unlike length another one may well be nearer than the vector itself
    products[np.arange(len(chosen)), chosen] = -np.inf
    near = np.argsort(-products, 1)[:, : min(k, n - 1)]
    rank = np.argsort(np.argsort(-(asked @ centres.T), 1), 1)
    seen = rank[np.arange(len(asked))[:, None], at[near]]
    probes = next((p for p in range(1, n_lists + 1) if not seen.size or (seen < p).mean() >= recall), n_lists)
    # where the scan ranks the true neighbours that lie in visited lists, as shares of these lists
    codes = encode(rest, direction, books, weight)
    decoded = books[np.arange(rest.shape[1]), codes].reshape(n, -1)[:, :dims]
    sizes, ranks = np.bincount(at, minlength=n_lists), []
    for q, own, inside in zip(asked, near, seen < probes, strict=True):
        order = np.argsort(-(decoded @ q), kind="stable")
        by_list = order[np.argsort(at[order], kind="stable")]
        place = np.empty(n)
        place[by_list] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ranks.append(((place[own] + 1) / sizes[at[own]])[inside])
    ranks = np.concatenate(ranks)
    share = float(np.quantile(ranks, recall, method="higher")) if len(ranks) else 1.0
    return Quantiser(centres, books, weight, probes, share)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries: tables are queries by pairs of codes by 256, codes rows by pairs of codes."""
    total = np.zeros((len(tables), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        total += np.take(tables[:, m], codes[:, m], axis=1)
    return total


def query_tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Products of each query with two neighbouring codes at once: queries by pairs of codes by 256."""
    one = np.einsum("qmd,mcd->qmc", paired(queries), books)
    if one.shape[1] % 2:
        one = np.concatenate((one, np.zeros((len(one), 1, CODES))), 1)
    both = one[:, 0::2, :, None] + one[:, 1::2, None, :]
    return both.reshape(len(one), -1, CODES * CODES).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate((codes, np.zeros((len(codes), 1), codes.dtype)), 1)
    return (codes[:, 0::2] * CODES + codes[:, 1::2]).astype(np.uint8)


def floors(queries: np.ndarray, ids: np.ndarray, known: np.ndarray, known_ids: np.ndarray, k: int) -> np.ndarray:
    """A score that the k best of each query have at least, by known vectors; -inf where there are too few."""
    if len(known) < k:
        return np.full(len(queries), -np.inf)
    products = queries @ known.T
    products[ids[:, None] == known_ids[None]] = -np.inf
    kth = np.argpartition(-products, k - 1, 1)[:, k - 1]
    low = products[np.arange(len(queries)), kth] - ROUNDING * lengths(queries) * lengths(known[kth])
    return np.where(np.isnan(low), -np.inf, low)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(-1))


@np.errstate(over="ignore", invalid="ignore")
def best(chunk: dict, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, centre: np.ndarray, books: np.ndarray, k: int, rerank: int, share: float):
    """The k best ids of a chunk (fewer, where others are below low) and their exact scores for each query."""
    # powers of two keep the order of a query's sums, and all of them finite
    (small, up), (few, wide) = ((np.ldexp(x, -e), e) for x, e in ((x, np.frexp(np.abs(x).max(axis, keepdims=True))[1]) for x, axis in ((queries, 1), (books, None))))
    tables = query_tables(small, few)
    rough = scan(tables, chunk["codes"])
    far = lengths(queries)[:, None]
    # sums of single precision are a little off, and so are those of double precision
    off = (tables.shape[1] + 2) * 2.0**-22 * np.abs(tables).max(2).sum(1, dtype=float, keepdims=True)
    upper = (queries @ centre)[:, None] + np.ldexp(rough + off, up + wide.ravel()[0]) + far * (chunk["errors"] + ROUNDING * (chunk["lengths"] + lengths(centre)))[None]
    # what is not a number leaves nothing out
    alive = ~(upper < low[:, None]) & (ids[:, None] != chunk["ids"][None])
    some = max(rerank, k, min(int(np.ceil(share * rough.shape[1])), 4 * rerank))
    close = None
    for q in range(len(ids)):
        mine = np.flatnonzero(alive[q])
        if len(mine) > some:
            first = mine[np.argpartition(-rough[q, mine], some - 1)[:some]]
            scores = (chunk["vectors"][first] * queries[q]).sum(1)
            kth = np.argpartition(-scores, k - 1)[k - 1]
            least = np.fmax(low[q], scores[kth])
            mine = mine[~(upper[q, mine] < least)]
            if len(mine) > some:
                close = queries @ chunk["vectors"].T if close is None else close
                mine = mine[~(close[q, mine] + ROUNDING * far[q] * chunk["lengths"][mine] < least)]
        # summed row by row: equal vectors have equal scores wherever they lie
        exact = (chunk["vectors"][mine] * queries[q]).sum(1)
        order = np.lexsort((chunk["ids"][mine], -exact))[:k]
        yield chunk["ids"][mine][order], exact[order]


def top(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of each query, by query and then nearest first."""
    query, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], ids[place < k], score[place < k]


def chunk_counts(widths: np.ndarray, dims: int, chunk_bytes: int) -> np.ndarray:
    """Chunks of each list of so many vectors; one that holds most vectors, such as equal ones, has as many as it needs."""
    return np.maximum(1, -(-widths * 8 * dims // chunk_bytes))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, rerank: int = 100, recall: float = 0.98, list_rows: int = 2048, most_lists: int = 4096, most_sample: int = 20_000, chunk_bytes: int = 64_000_000, most_held: int = 500_000) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each row of vectors where is_query (over the column id) holds. Learned from at most most_sample vectors, of
    more than 400 dimensions from as many as have 8 million components; lists are held in chunks of about chunk_bytes."""
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    out = f"query_id bigint, rank int, {id_col} bigint, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    dims, count = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dims)
    bound = max(256, min(most_sample, 8_000_000 // dims))
    packed_sample = rows.orderBy(F.xxhash64("id"), "id").limit(bound).select("v", "id").toArrow()
    sample = packed_sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dims)
    known = sample[: max(1, KNOWN // dims)]
    known_ids = packed_sample.column(1).to_numpy()[: len(known)]
    n_lists = max(1, min(most_lists, -(-count // list_rows)))
    model = fit_arrays(sample, n_lists, k=k, recall=recall)
    n_lists = len(model.centres)
    widths, radii = np.zeros(n_lists, np.int64), np.zeros(n_lists)

    def count_lists(batches):
        own, wide = np.zeros(n_lists, np.int64), np.zeros(n_lists)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                x = batch.column(0).slice(a, 2048).flatten().to_numpy().reshape(-1, dims)
                at = model.lists(x)
                own += np.bincount(at, minlength=n_lists)
                # what is not a number would be taken for no distance
                np.maximum.at(wide, at, np.nan_to_num(lengths(x - model.centres[at]), nan=np.inf))
        met = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(own[met], pa.int64()), pa.array(wide[met])], ["list", "n", "radius"])

    for r in rows.select("v").mapInArrow(count_lists, "list int, n bigint, radius double").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
        widths[r.list], radii[r.list] = r.n, r.radius
    chunks = chunk_counts(widths, dims, chunk_bytes)

    def place(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy().reshape(-1, dims)
                at = model.lists(x)
                direction = paired(x / np.linalg.norm(x, axis=1, keepdims=True))
                rest = paired(x - model.centres[at])
                found = encode(rest, direction, model.books, model.weight)
                errors = np.nan_to_num(lengths((rest - model.books[np.arange(rest.shape[1]), found]).reshape(len(x), -1)), nan=np.inf)
                codes = packed(found)
                raw = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[at], pa.int64()), pa.array(np.zeros(len(ids)), pa.int32()), part.column(0), pa.array([raw[8 * dims * i : 8 * dims * (i + 1)] for i in range(len(ids))], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)],
                    ["list", "chunk", "kind", "id", "v", "codes", "bound"],
                )

    def visit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                x = part.column(1).flatten().to_numpy().reshape(-1, dims)
                low = floors(x, part.column(0).to_numpy(), known, known_ids, k)
                products = x @ model.centres.T
                near = np.argsort(-products, 1, kind="stable")
                most = products + lengths(x)[:, None] * (radii + ROUNDING * (radii + lengths(model.centres)))
                able = ~(np.take_along_axis(most, near, 1) < low[:, None]) & (widths[near] > 0)
                # rows of the query's own id are no candidates
                before = np.cumsum(widths[near], 1) - widths[near]
                visited = (np.arange(n_lists) < model.probes) | (before < k + part.column(2).to_numpy()[:, None]) | able
                times = chunks[near[visited]]
                n = int(times.sum())
                owner = np.repeat(np.nonzero(visited)[0], times)
                raw = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(near[visited], times), pa.int32()), pa.array(np.arange(n) - np.repeat(np.cumsum(times) - times, times), pa.int64()), pa.array(np.ones(n), pa.int32()), part.column(0).take(pa.array(owner)), pa.array([raw[8 * dims * i : 8 * dims * (i + 1)] for i in owner], pa.binary()), pa.nulls(n, pa.binary()), pa.array(low[owner])],
                    ["list", "chunk", "kind", "id", "v", "codes", "bound"],
                )

    schema = "list int, chunk bigint, kind int, id bigint, v binary, codes binary, bound double"
    asked = rows.where(is_query).groupBy("id").agg(F.first("v").alias("v"), F.count("*").alias("own"))
    both = rows.mapInArrow(place, schema).unionByName(asked.mapInArrow(visit, schema))
    dealt = both.repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind")

    def answer(batches):
        now, parts, chunk = None, [], None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0

        def sent(query, ids, score):
            first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            ends = pa.array(np.append(first, len(query)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(query[first]), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(score))], ["query_id", "ids", "scores"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                group, kind = tuple(keys[a, :2]), keys[a, 2]
                if group != now:
                    now, parts, chunk = group, [], None
                part = batch.slice(a, b - a)
                if kind == 0:
                    parts.append(part)
                    continue
                if chunk is None and parts:
                    n = sum(p.num_rows for p in parts)
                    chunk = {
                        "ids": np.concatenate([p.column(3).to_numpy() for p in parts]),
                        "vectors": np.frombuffer(b"".join(x for p in parts for x in p.column(4).to_pylist())).reshape(n, dims),
                        "codes": np.frombuffer(b"".join(x for p in parts for x in p.column(5).to_pylist()), np.uint8).reshape(n, -1).astype(np.intp),
                        "errors": np.concatenate([p.column(6).to_numpy() for p in parts]),
                    }
                    chunk["lengths"] = lengths(chunk["vectors"])
                if chunk is None:
                    continue
                for c in range(0, part.num_rows, 128):
                    some = part.slice(c, 128)
                    ids = some.column(3).to_numpy()
                    queries = np.frombuffer(b"".join(some.column(4).to_pylist())).reshape(len(ids), dims)
                    found = list(best(chunk, ids, queries, some.column(6).to_numpy(), model.centres[now[0]], model.books, k, rerank, model.share))
                    held += [(np.full(len(x), q), x, y) for q, (x, y) in zip(ids, found, strict=True)]
                    n_held += sum(len(x) for x, _ in found)
                    if n_held > most_held:
                        best_now = top(held, k)
                        held, n_held = [best_now], len(best_now[0])
                        if n_held > most_held // 2:
                            yield sent(*best_now)
                            held, n_held = [], 0
        if n_held:
            yield sent(*top(held, k))

    found = dealt.mapInArrow(answer, "query_id bigint, ids array<bigint>, scores array<double>")
    # each task sends k at most, or as often as it holds its most, so a query's row is bounded by the tasks
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("i")))
    merged = found.select("query_id", pairs.alias("p")).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    return merged.select("query_id", F.posexplode("p").alias("r", "x")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.i").alias(id_col), (-F.col("x.s")).alias("score"))
