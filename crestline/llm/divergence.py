"""How far the sources of a language differ, and the terms that set each source apart.

Terms are counted by language and source within tasks and then by Spark. With the counts of a group (language and
source) come smoothed shares p in billionths, and two shares differ by floor((p - q)^2 / (p + q)), all in whole numbers.

Pairs of sources: most terms are missing from most sources, where the share is the group's base, so all terms
are first taken to be missing from both (one product); terms of one source are corrected for by the histogram of its counts; only terms that
both hold need their two shares. These come together by term, in blocks of sources, and each task adds them up by
pair before anything is sent on.

Leading terms of a group: histograms of the value's bits, from the highest down, give the value that the k-th term has;
of the terms with just this value, histograms of their UTF-8 bytes, from the first on, find the last that is within. Nothing is
sorted but what is returned.

Defined results: null text, language and source count as empty; every group that occurs takes part, also without a term; a language
in which no term is kept has pairs of value 0; a language of one source has no pairs; terms of equal value go by UTF-8
bytes; repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.arrow_text import row_spans, text_bytes
from crestline.llm.cut import cut

#: Runs of bytes of A-Z (in lower case by then) and of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SPAN_BYTES = 4_000_000
UNIT = 1_000_000_000
#: Bits of a value, and bytes of a term, that the first histograms take at once.
VALUE_BITS, FIRST_BYTES = 10, 2
#: Sources of a block; terms meet by pairs of blocks.
BLOCK = 256
#: Rows of a table of groups (under 20 MB) up to which it is broadcast.
MOST_BROADCAST = 100_000


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most_terms: int = 400_000) -> DataFrame:
    """(lang, source, term, n, docs) of all rows, and a row with a null term for the documents of each group."""
    held_as = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*held_as, F.col(text_col).cast("string").alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (uses, within) in held.items():
                size = len(within)
                terms = pa.array(list(within), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array([uses[t] for t in within], pa.int64()), pa.array(list(within.values()), pa.int64())], names)
            held.clear()

        for batch in batches:
            for a, b in row_spans(batch.column(2), SPAN_BYTES):
                part = batch.slice(a, b - a)
                raw, ends = text_bytes(part.column(2))
                data = raw.tobytes().lower()
                for lang, source, (x, y) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), itertools.pairwise(ends.tolist()), strict=True):
                    found = TERM.findall(data, x, y)
                    uses, within = held.setdefault((lang, source), (Counter(), Counter()))
                    uses.update(found)
                    within.update(set(found))
                    within[None] += 1
                if sum(len(w) for _, w in held.values()) > most_terms:
                    yield from flush()
        yield from flush()

    # tasks have added up what they can, so rows go to where they are summed as they are
    counted = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "source", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), in whole numbers."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0)) div CAST({total} + 2 * {kept} AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def leading(rows: DataFrame, groups: Sequence[str], value: str, item: str, k: int) -> DataFrame:
    """The k rows of each group with the largest value (whole, from 0 on), ties by the bytes of item, and their rank.

    No group may hold an item twice. rows are read once for each histogram, so they should be a table."""
    groups = list(groups)
    first = rows.agg(F.max(value).alias("top"), F.min(value).alias("low")).first()
    if first.low is not None and first.low < 0:
        raise ValueError(f"values of {value} below 0")
    rounds = max(1, -(-int(first.top or 0).bit_length() // VALUE_BITS))
    down = Window.partitionBy(*groups).orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, 0)
    state = cut(rows.groupBy(*groups).agg(F.count("*").alias("rows")).select(*groups, F.when(F.col("rows") > k, k).alias("need"), F.lit(0).cast("bigint").alias("prefix")))
    n_groups = state.count()
    for r in reversed(range(rounds)):
        low = r * VALUE_BITS
        now = rows.select(*groups, F.col(value).alias("v")).join(small(state.where("need is not null"), n_groups), groups)
        now = now.where(F.expr(f"shiftright(v, {low + VALUE_BITS}) = prefix"))
        bins = now.groupBy(*groups, F.expr(f"shiftright(v, {low}) & {(1 << VALUE_BITS) - 1}").alias("digit")).agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("prefix").alias("prefix"))
        bins = bins.withColumn("upto", F.sum("n").over(down)).where("upto >= need and upto - n < need")
        settled = bins.select(*groups, F.expr("need - (upto - n)").alias("need"), F.expr(f"shiftleft(prefix, {VALUE_BITS}) | digit").alias("prefix"))
        state = cut(settled.unionByName(state.where("need is null")))
    # groups of at most k rows keep all, the others what lies above the threshold and the first ties
    bound = state.select(*groups, "need", F.when(F.col("need").isNull(), -1).otherwise(F.col("prefix")).alias("bound"))
    above = rows.join(small(bound.drop("need"), n_groups), groups).where(F.col(value) > F.col("bound")).drop("bound")
    ties = rows.join(small(bound.where("need is not null"), n_groups), groups).where(F.col(value) == F.col("bound")).drop("bound")
    ties = cut(ties.withColumn("bytes", F.col(item).cast("binary")))
    up = Window.partitionBy(*groups).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    open_ = cut(ties.groupBy(*groups).agg(F.count("*").alias("n"), F.first("need").alias("need")).select(*groups, "need", F.lit(b"").alias("prefix"), F.lit(0).alias("span"), (F.col("n") > F.col("need")).alias("open")))
    done, width = [open_.where("not open")], FIRST_BYTES
    while not (open_ := open_.where("open")).isEmpty():
        own = ties.select(*groups, "bytes").join(small(open_, n_groups), groups).where("substring(bytes, 1, length(prefix)) = prefix")
        bins = own.groupBy(*groups, F.expr(f"substring(bytes, length(prefix) + 1, {width})").alias("digit")).agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("prefix").alias("prefix"))
        bins = bins.withColumn("upto", F.sum("n").over(up)).where("upto >= need and upto - n < need").withColumn("span", F.length("prefix") + width)
        open_ = cut(bins.select(*groups, F.expr("need - (upto - n)").alias("need"), F.concat("prefix", "digit").alias("prefix"), "span", (F.col("upto") > F.col("need")).alias("open")))
        done.append(open_.where("not open"))
        width *= 2
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    # where the last item within ends before the span does, those that go on from it are beyond
    within = ties.drop("need").join(small(last.select(*groups, "prefix", "span"), n_groups), groups).where("substring(bytes, 1, span) <= prefix").drop("bytes", "prefix", "span")
    order = Window.partitionBy(*groups).orderBy(F.desc(value), F.col(item))
    return above.unionByName(within).withColumn("rank", F.row_number().over(order).cast("int"))


def pair_sums(arrays: DataFrame) -> DataFrame:
    """(lang, a, b, x) for a < b from rows (lang, i, j, held) of one term and one pair of blocks: what both shares change against one at its base."""
    names = ["lang", "a", "b", "x"]

    def run(batches):
        sums: Counter = Counter()

        def flush():
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in keys], t) for c, t in ((0, pa.string()), (1, pa.int32()), (2, pa.int32()))] + [pa.array(list(sums.values()), pa.int64())], names)
            sums.clear()

        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            lang, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            one_block = (batch.column(1).to_numpy() == batch.column(2).to_numpy())
            held = batch.column(3)
            sizes = np.diff(held.offsets.to_numpy())
            place, p, base = (held.flatten().field(c).to_numpy() for c in range(3))
            term = np.repeat(np.arange(len(sizes)), sizes)
            # entries of a term lie side by side by place; each step pairs all with the one so many further on
            for k in range(1, int(sizes.max(initial=1))):
                at = np.flatnonzero(term[k:] == term[:-k])
                a, b = at, at + k
                across = one_block[term[a]] | (place[a] // BLOCK != place[b] // BLOCK)
                a, b = a[across], b[across]
                if not len(a):
                    continue
                f = lambda x, y: (x - y) * (x - y) // (x + y)
                x = f(p[a], p[b]) - f(p[a], base[b]) - f(base[a], p[b]) + f(base[a], base[b])
                keys = np.stack((code[term[a]].astype(np.int64), place[a].astype(np.int64), place[b].astype(np.int64)), 1)
                order = np.lexsort(keys.T[::-1])
                keys, x = keys[order], x[order]
                starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
                for (c, u, v), total in zip(keys[starts].tolist(), np.add.reduceat(x, starts).tolist(), strict=True):
                    sums[lang[c], u, v] += total
            if len(sums) > 1_000_000:
                yield from flush()
        yield from flush()

    return arrays.mapInArrow(run, "lang string, a int, b int, x bigint")


def audit(docs: DataFrame, *, least_docs: int = 10, k: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by how far they differ, part `term` the k terms that stand out most."""
    counts = term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    # the rows of a term are as many as its sources
    within = Window.partitionBy("lang", "term")
    counts = counts.withColumn("n_lang", F.sum("n").over(within)).withColumn("docs", F.sum("docs").over(within))
    table = cut(counts.where((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs"))
    own = table.where("term is not null")
    per_lang = own.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total_lang"))
    totals = table.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = totals.join(per_lang, "lang", "left").fillna(0, ["kept", "total_lang"])
    totals = totals.withColumn("base", F.when(F.col("kept") > 0, share("0", "total", "kept")))
    totals = cut(totals.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    n_groups = totals.count()
    shares = own.join(small(totals, n_groups), ["lang", "source"]).withColumn("p", share("n", "total", "kept"))

    # leading terms
    valued = shares.withColumn("q", share("n_lang", "total_lang", "kept")).where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    top = leading(cut(valued), ["lang", "source"], "value", "item", k).withColumn("part", F.lit("term"))

    # pairs
    one = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"), F.first("base").alias("base"))
    others = totals.where("kept > 0").select("lang", F.col("source").alias("item"), F.col("base").alias("base_item"))
    one = one.join(small(others, n_groups), "lang").where("source <> item")
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.expr("m * (((p - base_item) * (p - base_item)) div (p + base_item) - ((base - base_item) * (base - base_item)) div (base + base_item))")).alias("x"))
    turned = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "x")
    last = totals.groupBy("lang").agg((F.max("place") / BLOCK).cast("int").alias("last"))
    near = shares.select("lang", "term", "place", "p", "base").join(small(last, n_groups), "lang").withColumn("block", (F.col("place") / BLOCK).cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    near = near.groupBy("lang", "term", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.sort_array(F.collect_list(F.struct("place", "p", "base"))).alias("held"))
    met = pair_sums(near.where("size(held) > 1").select("lang", "i", "j", "held")).groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))
    named = totals.select("lang", "place", "source")
    met = met.join(small(named.select("lang", F.col("place").alias("a"), "source"), n_groups), ["lang", "a"]).join(small(named.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), n_groups), ["lang", "b"])
    met = met.select("lang", "source", "item", "x")
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "x")
    flat = totals.join(small(totals.select("lang", F.col("source").alias("item"), F.col("base").alias("base_item")), n_groups), "lang").where("source <> item")
    flat = flat.select("lang", "source", "item", F.expr("CASE WHEN kept > 0 THEN kept * (((base - base_item) * (base - base_item)) div (base + base_item)) ELSE 0 END").alias("x"))
    pairs = flat.unionByName(one).unionByName(turned).unionByName(met).unionByName(back).groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(top.select(*columns))
