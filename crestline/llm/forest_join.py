"""Jaccard self-join of word shingles by a MinHash LSH forest.

Each text has a signature of trees x depth minima, the depth minima of a tree being its label there. The labels of a
tree make a prefix trie, kept as its leaves in sorted order. Texts meet at the nodes of the trie, from whole labels on: a text whose
sub-trie still holds texts outside its own family goes on with a prefix shorter by one minimum, one that has met all of them
stops. Shortening ends at the depth at which the chance that a pair at the threshold meets in some tree
reaches the target recall (`prefix_depth`: 4 of 6 minima as set). So every pair of the recall is met, while the members of a
large family are compared at the first node that holds them and not again below it. Sub-tries are dealt to
tasks by the shortest prefix, sorted by the rest of their labels: neighbours there share the longest prefixes, and are compared first.

Texts that meet are compared by their signatures, and only a spanning forest of the likely pairs leaves a task; its connected components
are families. Within a family every pair is then verified exactly on the shingle
sets, block by block, and counted where it is found: pairs are never emitted.

Texts of equal shingle sets are one representative from the start, so a large group of
copies is one row. Prefixes and families of any size are dealt out as pairs of blocks.

Defined results: a text with 1 to 4 words is one shingle of all its words; a text without
words (null and empty ones) links to nothing and is a class of its own row; repeated rows are copies
of each other; rows without id take part, and a class in which no row has an id has a null class_id; an empty table gives
an empty result; further columns are not read.
A link needs Jaccard similarity of at least `threshold`; n_links counts rows, copies included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.arrow_text import row_spans
from crestline.llm.components import components
from crestline.llm.cut import cut
from crestline.llm.shingles import min_hashes, mix, set_keys, shingle_sets

SPAN_BYTES = 4_000_000
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 20


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from whole labels down, at which pairs at the threshold meet the recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("more trees are needed for this recall")


def labels(signatures: np.ndarray, trees: int, depth: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text and tree, a 64-bit number that is equal where the first `prefix` minima are, and the further minima of
    the label, 16 bits each with the earlier ones above."""
    top = np.zeros((len(signatures), trees), np.uint64)
    rest = np.zeros((len(signatures), trees), np.uint64)
    for t in range(trees):
        h = np.full(len(signatures), np.uint64(t + 1))
        for d in range(prefix):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, t * depth + d])
        top[:, t] = h
        for d in range(prefix, depth):
            rest[:, t] = rest[:, t] << np.uint64(16) | signatures[:, t * depth + d].astype(np.uint64) & np.uint64(0xFFFF)
    return top, rest


def sign(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int, prefix: int, size: int) -> DataFrame:
    """id, name (of the text, only of rows without id), key (of the shingle set, null without words), shingles (their number), labels (prefix and rest by tree), and sketch (a byte of each minimum)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("name", F.when(F.col("id").isNull(), F.xxhash64("text")))

    def run(batches):
        for batch in batches:
            for a, b in row_spans(batch.column(1), SPAN_BYTES):
                part = batch.slice(a, b - a)
                hashes, borders = shingle_sets(part.column(1), size)
                counts = np.diff(borders)
                minima = min_hashes(hashes, borders, trees * depth)
                top, rest = (pa.array(x.ravel().view(np.int64)) for x in labels(minima, trees, depth, prefix))
                under = pa.ListArray.from_arrays(pa.array(np.arange(len(minima) + 1, dtype=np.int32) * trees), pa.StructArray.from_arrays([top, rest], ["label", "rest"]))
                sketch = (minima & np.uint32(255)).astype(np.uint8)
                keys = [k if n else None for k, n in zip(set_keys(hashes, borders), counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), under, pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["id", "name", "key", "shingles", "labels", "sketch"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, name bigint, key binary, shingles bigint, labels array<struct<label: bigint, rest: bigint>>, sketch binary")


def whole_groups(batches, keys: list[str]):
    """Tables that never end inside a group, from batches sorted by keys; with group starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 4096:
            continue
        joined = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(joined, keys)
        if starts[-1] > 0:
            yield joined.slice(0, starts[-1]), starts[:-1]
        held = joined.slice(starts[-1]).to_batches()
    if held:
        joined = pa.Table.from_batches(held).combine_chunks()
        yield joined, group_starts(joined, keys)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    same = np.ones(max(0, table.num_rows - 1), bool)
    for k in keys:
        column = table.column(k)
        values = column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)
        same &= values[1:] == values[:-1]
    new[1:] = ~same
    return np.flatnonzero(new)


def roots_of(near: np.ndarray) -> np.ndarray:
    """For a symmetric table of links, the least member of each one's component."""
    n, root = len(near), np.full(len(near), -1)
    for s in range(n):
        if root[s] >= 0:
            continue
        root[s] = s
        edge = np.array([s])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & (root < 0))
            root[edge] = s
    return root


def likely_edges(table: pa.Table, starts: np.ndarray, least: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the likely pairs of each sub-trie, as row numbers; rows are sorted by the rest of their labels, of levels minima."""
    n = table.num_rows
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
    rest = table.column("rest").to_numpy().view(np.uint64)
    sizes = np.diff(np.concatenate((starts, [n])))
    inner = np.ones(n, bool)
    inner[starts] = False
    beside = inner.copy()
    beside[1:] &= (sketch[1:] == sketch[:-1]).mean(1) >= least
    u, v = [np.flatnonzero(beside) - 1], [np.flatnonzero(beside)]
    odd = (np.add.reduceat(inner & ~beside, starts) > 0) & (sizes > 2)
    for a, size in zip(starts[odd], sizes[odd], strict=True):
        own, tails = sketch[a : a + size], rest[a : a + size]
        family = np.cumsum(~beside[a : a + size])
        for level in range(levels + 1):
            ends = np.append(np.flatnonzero(np.diff(tails)) + 1, size)
            for low, high in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                for i in range(low, high):
                    mine = family[low:high]
                    if (mine == mine[0]).all():
                        break
                    met = np.flatnonzero((mine != family[i]) & ((own[low:high] == own[i]).mean(1) >= least))
                    for j in met[np.unique(mine[met], return_index=True)[1]] if len(met) else ():
                        u.append(np.array([a + i]))
                        v.append(np.array([a + low + j]))
                        family[family == family[low + j]] = family[i]
            if (family == family[0]).all():
                break
            tails = tails >> np.uint64(16)
    return np.concatenate(u), np.concatenate(v)


def families(reps: DataFrame, least: float, block_rows: int, levels: int) -> DataFrame:
    """(key, family) of the representatives that may have a link."""
    under = reps.select("key", F.inline("labels"))
    sizes = under.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    shared = under.join(sizes, "label").groupBy("key").agg(F.collect_list(F.struct("label", "rest", "n")).alias("under"))
    spread = shared.join(reps.select("key", "sketch"), "key").select("key", "sketch", F.explode("under").alias("x")).select("key", "sketch", "x.label", "x.rest", F.ceil(F.col("x.n") / block_rows).alias("blocks"))
    dealt = deal(spread, "label", ["rest"])

    def run(batches):
        for table, starts in whole_groups(batches, ["label", "i", "j"]):
            u, v = likely_edges(table, starts, least, levels)
            keys = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(u)).cast(pa.binary()), keys.take(pa.array(v)).cast(pa.binary())], ["u", "v"])

    edges = dealt.mapInArrow(run, "u binary, v binary")
    return components(edges).select(F.col("node").alias("key"), F.col("root").alias("family"))


def deal(rows: DataFrame, group: str, extra: list[str]) -> DataFrame:
    """Give each row of a group of several blocks to every pair of blocks that its own is in, and bring pairs of blocks together."""
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = rows.withColumn("own", own).withColumn("other", other)
    placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    return placed.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", *extra, "key")


def verify(sets: list[np.ndarray], block: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Table of the links among sets: of all pairs, or only of those across two blocks."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    shared = np.zeros((n, n))
    if n <= 6:
        for i in range(n):
            for j in range(i):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        kept = often[place] > 1
        owner, place = owner[kept], (np.cumsum(often > 1) - 1)[place[kept]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        step, width = max(1, (1 << 22) // n), int(place[-1]) + 1 if len(place) else 0
        for a in range(0, width, step):
            low, high = np.searchsorted(place, (a, a + step))
            part = np.zeros((n, min(step, width - a)), np.float32)
            part[owner[low:high], place[low:high] - a] = 1
            shared += part @ part.T
    joined = sizes[:, None] + sizes[None, :] - shared
    near = shared >= threshold * joined - 1e-9
    np.fill_diagonal(near, False)
    return near & (block[:, None] != block[None, :]) if across else near


def links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int, threshold: float, unnamed: bool) -> DataFrame:
    """(key, n, root) for each member and pair of blocks: rows linked to it and the least key of its component there; unnamed: whether members without id occur."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    members = members.drop("shingles")
    rows = texts.join(members.drop("name"), "id").drop("id")
    if unnamed:
        # any row of a text without id will do, so one comes along
        own = texts.where("id is null").select("text").distinct().withColumn("name", F.xxhash64("text"))
        rows = rows.unionByName(own.join(members.where("id is null").drop("id"), "name").drop("name"))

    def cut_up(batches):
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for a, b in row_spans(batch.column(column), SPAN_BYTES):
                part = batch.slice(a, b - a)
                hashes, borders = shingle_sets(part.column(column), size)
                raw = hashes.tobytes()
                sets = pa.array([raw[8 * x : 8 * y] for x, y in zip(borders[:-1], borders[1:], strict=True)], pa.binary())
                keys = pa.array(set_keys(hashes, borders), pa.binary())
                yield pa.RecordBatch.from_arrays([keys, *[part.column(c) for c in ("key", "family", "copies", "blocks")], sets], ["own_key", "key", "family", "copies", "blocks", "hashes"])

    # rows that repeat an id with another text are told apart by the key
    made = rows.mapInArrow(cut_up, "own_key binary, key binary, family binary, copies bigint, blocks bigint, hashes binary").where("own_key = key").drop("own_key")
    dealt = deal(made, "family", [])

    def run(batches):
        for table, starts in whole_groups(batches, ["family", "i", "j"]):
            keys, copies = table.column("key").to_pylist(), table.column("copies").to_numpy()
            hashes, own = table.column("hashes"), table.column("own").to_numpy()
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                picked = [a]
                picked += [x for x in range(a + 1, b) if keys[x] != keys[x - 1]]
                at = np.array(picked)
                sets = [np.frombuffer(hashes[int(x)].as_py(), np.uint64) for x in at]
                near = verify(sets, own[at], i[a] != j[a], threshold)
                out[0].extend(keys[x] for x in at)
                out[1].extend((near @ copies[at]).tolist())
                out[2].extend(keys[at[r]] for r in roots_of(near))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["key", "n", "root"])

    return dealt.mapInArrow(run, "key binary, n bigint, root binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, trees: int = 14, depth: int = 6, recall: float = 0.999, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: id, class_id (least id of the class, null if no row of it has one), n_links and n_copies (rows with the same shingle set, itself included)."""
    prefix = prefix_depth(threshold, trees, depth, recall)
    signed = cut(sign(docs, id_col, text_col, trees, depth, prefix, size))
    worded = signed.where("key is not null")
    # labels and sketch depend on the key alone, so any copy's will do
    reps = cut(worded.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.min("name").alias("name"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles")))
    least = max(0.0, threshold - 4.5 * (threshold * (1 - threshold) / (trees * depth)) ** 0.5)
    family = cut(families(reps, least, block_rows, depth - prefix))
    in_family = reps.select("key", "id", "name", "copies", "shingles").join(family, "key")
    widths = in_family.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("shingles") / block_shingles)).alias("blocks"))
    members = in_family.join(widths, "family")
    found = cut(links(docs, members, id_col, text_col, size, threshold, not reps.where("id is null").isEmpty()))
    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    joined = components(found.where("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    classes = reps.select("key", "id", "copies").join(counted, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    classes = classes.withColumn("root", F.coalesce("root", "key"))
    ids = classes.groupBy("root").agg(F.min("id").alias("class_id"))
    classes = classes.join(ids, "root").select("key", "class_id", "copies", F.coalesce("n", F.lit(0)).alias("n"))
    whole = signed.select("id", "key").join(classes, "key", "left")
    return whole.select(
        F.col("id").alias(id_col),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_marks: int = 250_000, **options) -> DataFrame:
    """All columns of docs, one row of each class of near duplicates: that of the least id. A row
    without id is named by its text, behind all others. Rows without words link to nothing and stay, but
    of rows that repeat both id and text one stays.

    The rows to drop, and those that repeat, are counted: up to most_marks of them (about 50 MB) are broadcast, so that
    texts stay where they are; more are joined."""
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    name = F.struct(F.col(id_col).isNull().alias("n"), F.coalesce(F.col(id_col).cast("long"), text).alias("i"), text.alias("h"))
    # what comes in travels in one column, so that no name of its own can clash
    rows = docs.select(name.alias("_row"), F.col(text_col).alias("_text"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_held"))
    found = near_duplicates(rows.select("_row", "_text"), id_col="_row", text_col="_text", **options)
    rows = rows.drop("_text")
    # rows of one name have one text, so one class
    marks = found.groupBy("_row").agg(F.max(F.col("_row") != F.col("class_id")).alias("_lost"), (F.count("*") > 1).alias("_again"))
    marks = cut(marks.where("_lost or _again"))
    counted = marks.agg(F.count("*").alias("n"), F.max("_again").alias("again")).first()
    marked = rows.join(F.broadcast(marks) if counted.n <= most_marks else marks, "_row", "left")
    kept = marked.where("_lost is null")
    if counted.again:
        place = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
        twice = marked.where("not _lost and _again").withColumn("_place", place).where("_place = 1").drop("_place")
        kept = kept.unionByName(twice)
    return kept.select("_held.*")
