"""Mixing sources to target weights by proportionate-fair scheduling, with DataFrame functions only.

Rows of a source, in a fixed order, form blocks of block_rows rows. Weights are positive
integers. Time is cut into frames; in each, source s has w_s blocks to place among the
W of the frame (fewer once it runs out). Block k of m in a frame is released at
floor(k W / m) and due at ceil((k + 1) W / m); the earliest due of the released blocks
takes the next slot. So at each slot every source is less than one block from its
share. All frames with the same supply have the same schedule, which is worked out
once; when a source ends, the others share its place by their weights. No row is dropped
or repeated.

Rows are numbered without gathering a source: each falls in one of `cells` hash cells, is
numbered within its cell, and cells are added up from their counts. Schedules are broadcast;
their size is the number of sources times the sum of weights times the number of
supplies (at most two a source and one), and `most_entries` checks it. Each supply is worked out in a task of its own,
slot by slot among all sources: some thousands of sources, with weights in the tens, are what this is made for.

Defined results: rows with a null source form a source of their own with the default
weight; rows with one order_col go by a hash of their columns, and rows alike in all get one place each; texts
are not read for anything else; an empty table gives an empty result; input columns named like
the new ones are replaced, all others pass through whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW = ["weight", "block", "slot", "release", "deadline", "position"]


def whole_weights(weights: dict[str, float], resolution: int = 1000) -> dict[str, int]:
    """Integers in proportion to weights: exact where they have small denominators, else rounded to a part of resolution, at least 1."""
    exact = {k: Fraction(v).limit_denominator(resolution) for k, v in weights.items()}
    common = 1
    for v in exact.values():
        common = common * v.denominator // _gcd(common, v.denominator)
    if common <= resolution:
        return {k: max(1, int(v * common)) for k, v in exact.items()}
    total = sum(weights.values())
    return {k: max(1, round(v / total * resolution)) for k, v in weights.items()}


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def _weight_of(source: Column, weights: dict[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(pairs, source), F.lit(default))


def schedule(supply: DataFrame) -> DataFrame:
    """From (source, w, blocks) a row for each source and slot of each kind of frame: source, first and last
    frame (exclusive) of that kind, start (first slot of that kind), width, and slots (array of place, release, deadline by block)."""
    one = supply.agg(F.array_sort(F.collect_list(F.struct("source", F.col("w").cast("long").alias("w"), F.col("blocks").cast("long").alias("n")))).alias("all"))
    # a source has w blocks in frames before n div w, n mod w in that one, none later
    turns = F.flatten(F.transform("all", lambda s: F.array(F.floor(s["n"] / s["w"]), F.ceil(s["n"] / s["w"]))))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), turns)))
    kinds = one.select("all", F.posexplode(F.arrays_zip(F.slice(edges, F.lit(1), F.size(edges) - 1).alias("a"), F.slice(edges, F.lit(2), F.size(edges)).alias("b"))).alias("kind", "edge"))
    kinds = kinds.select("all", "kind", F.col("edge.a").alias("first"), F.col("edge.b").alias("last"))
    # one kind's slots take far longer than its row is large, so tasks are counted, not sized
    kinds = kinds.repartition(supply.sparkSession.sparkContext.defaultParallelism, "kind")
    due = kinds.withColumn("m", F.transform("all", lambda s: F.greatest(F.lit(0).cast("long"), F.least(s["w"], s["n"] - s["w"] * F.col("first")))))
    due = due.withColumn("width", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x))
    # the state: blocks done by source, and the source placed in each slot so far
    step = """
        aggregate(sequence(0L, width - 1), named_struct('done', transform(m, x -> 0L), 'order', cast(array() as array<int>)), (state, t) ->
            transform(array(array_min(transform(
                filter(sequence(0, size(m) - 1), i -> state.done[i] < m[i] and floor(state.done[i] * width / m[i]) <= t),
                i -> named_struct('d', ceil((state.done[i] + 1) * width / m[i]), 'i', i))).i),
            pick -> named_struct('done', transform(state.done, (x, i) -> if(i = pick, x + 1, x)), 'order', state.order || array(pick)))[0]
        ).order
    """.replace("floor(state.done[i] * width / m[i])", "(state.done[i] * width) div m[i]").replace("ceil((state.done[i] + 1) * width / m[i])", "((state.done[i] + 1) * width + m[i] - 1) div m[i]")
    placed = due.where("width > 0").withColumn("order", F.expr(step))
    before = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)  # over two numbers a kind
    starts = due.where("width > 0").select("kind", F.coalesce(F.sum(F.expr("width * (last - first)")).over(before), F.lit(0)).alias("start"))
    placed = placed.join(starts, "kind")
    each = placed.select("first", "last", "start", "width", "m", "order", F.posexplode("all").alias("i", "s")).withColumn("mine", F.expr("m[i]")).where("mine > 0")
    return each.select(
        F.col("s.source").alias("source"),
        F.struct(
            "first",
            "last",
            "start",
            "width",
            F.expr("""transform(filter(sequence(0, size(order) - 1), t -> order[t] = i), (t, k) -> named_struct(
                'place', cast(t as long), 'release', (k * width) div mine, 'deadline', ((k + 1) * width + mine - 1) div mine))""").alias("slots"),
        ).alias("frame"),
    )


def mix(docs: DataFrame, weights: dict[str, int], *, default_weight: int = 1, source_col: str = "source", order_col: str = "doc_id", block_rows: int = 1, cells: int = 4096, most_entries: int = 5_000_000) -> DataFrame:
    """All columns of docs and: weight; block (of the source, from 0); slot (of the block in the mix), release and
    deadline (bounds that the schedule sets for slot: release <= slot < deadline); position (of the row, from 0)."""
    if default_weight < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    kept = docs.drop(*NEW)
    hashed = [F.col(f"`{f.name}`") for f in kept.schema.fields if "map<" not in f.dataType.simpleString()]
    # what comes in travels in one column, so that no name of its own can clash
    rows = kept.select(F.struct(*[f"`{c}`" for c in kept.columns]).alias("_held"), F.col(source_col).cast("string").alias("_given"), F.col(order_col).alias("_by"), F.xxhash64(*hashed).alias("_hash"))
    digest = F.md5(F.coalesce(F.col("_by").cast("string"), F.lit("")))
    rows = rows.withColumn("_cell", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % cells).withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("_given")), F.lit("-")))
    counts = rows.groupBy("_source", "_cell").agg(F.count("*").alias("_n"))
    named = F.when(F.col("_source") != "-", F.expr("substring(_source, 2)"))
    totals = counts.groupBy("_source").agg(F.sum("_n").alias("rows")).select(F.col("_source").alias("source"), _weight_of(named, weights, default_weight).alias("w"), F.ceil(F.col("rows") / block_rows).alias("blocks"))
    frames = schedule(totals).groupBy("source").agg(F.array_sort(F.collect_list("frame")).alias("_frames"))
    size = frames.agg(F.coalesce(F.sum(F.expr("aggregate(_frames, 0L, (a, f) -> a + size(f.slots) + 1)")), F.lit(0)).alias("n")).first().n
    small = size <= most_entries
    earlier = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "_cell").orderBy("_by", "_hash")) - 1)
    numbered = numbered.join(offsets, ["_source", "_cell"]).withColumn("_place", F.col("_before") + F.col("_in"))
    frames = frames.withColumnRenamed("source", "_source")
    # beyond the checked size the frames are dealt out by source, and Spark splits the large ones
    found = numbered.join(F.broadcast(frames) if small else frames, "_source")
    found = found.withColumn("weight", _weight_of(F.col("_given"), weights, default_weight).cast("long")).withColumn("block", F.expr(f"_place div {block_rows}"))
    found = found.withColumn("_f", F.expr("block div weight"))
    found = found.withColumn("_frame", F.expr("filter(_frames, f -> f.first <= _f and _f < f.last)[0]"))
    found = found.withColumn("_slot", F.expr("_frame.slots[cast(block % weight as int)]")).withColumn("_base", F.expr("_frame.start + (_f - _frame.first) * _frame.width"))
    done = found.withColumns({"slot": F.expr("_base + _slot.place"), "release": F.expr("_base + _slot.release"), "deadline": F.expr("_base + _slot.deadline")})
    if block_rows == 1:
        done = done.withColumn("position", F.col("slot"))
    else:
        # only the last block of a source can be short; each row comes so much earlier as those before it lack
        lacks = frames_short(totals, frames, block_rows, counts)
        done = done.withColumn("position", F.col("slot") * block_rows + F.expr(f"_place % {block_rows}")).join(F.broadcast(lacks)).withColumn("position", F.expr("position - aggregate(_lacks, 0L, (a, x) -> a + if(x.slot < slot, x.lack, 0))")).drop("_lacks")
    return done.select("_held.*", *NEW)


def frames_short(totals: DataFrame, frames: DataFrame, block_rows: int, counts: DataFrame) -> DataFrame:
    """One row with an array of the slots whose block is short and the rows that it lacks (at most one a source)."""
    held = counts.groupBy("_source").agg(F.sum("_n").alias("rows"))
    last = held.join(totals.withColumnRenamed("source", "_source"), "_source").join(frames, "_source").where(f"rows % {block_rows} > 0")
    last = last.withColumn("b", F.col("blocks") - 1).withColumn("f", F.expr("b div w")).withColumn("fr", F.expr("filter(_frames, x -> x.first <= f and f < x.last)[0]"))
    slot = F.expr("fr.start + (f - fr.first) * fr.width + fr.slots[cast(b % w as int)].place")
    return last.agg(F.collect_list(F.struct(slot.alias("slot"), F.expr(f"cast({block_rows} - rows % {block_rows} as long)").alias("lack"))).alias("_lacks"))
