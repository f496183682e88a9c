"""Periodic runs of words: maximal stretches that repeat a period at least four times.

A run's roots are Lyndon words under one of the two orders of words (with the end below all words):
some root of length q is the longest Lyndon word at its place. So a stack, scanned right to
left once under each order, yields at each place the longest Lyndon word there, whose length is a candidate period;
common extensions to both sides then give the whole stretch. Extensions are found by binary search over rolling hashes, and
what the search says is verified word by word; the stretch in which a distance is known to repeat is remembered, so
that a stretch is verified once.

Before that, whole batches are thinned exactly: each place of a run lies in four words of the run that
occur again, one period away, and a period is at most a quarter of the run. Places of no such four words lie in no run; a run cannot
cross them, so the stacks go over the stretches between them, and thinning is repeated on these.

Defined results: words are separated by the bytes 0x20 and 0x09 to 0x0D; a null or empty text has no word, no run and an
empty collapsed text; runs may overlap and all are listed, by start and period; repeated rows count each for itself; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.arrow_text import row_spans, text_bytes

SPAN_BYTES = 4_000_000
LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Words of a gram that must occur again; LEAST_LENGTH and LEAST_TIMES allow for 4.
GRAM = 4
#: Rolling hashes: a Mersenne prime, and a base.
PRIME, BASE = (1 << 61) - 1, 1_000_003_579_513
NEAR = 8


class Extensions:
    """Common extensions of places i < j of a list of word numbers, to the right and to the left."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.known: dict[int, tuple[int, int]] = {}
        self.sums: list[int] | None = None

    def _hashes(self) -> None:
        total, power = 0, 1
        self.sums, self.powers = [0], [1]
        for w in self.words:
            total = (total * BASE + w + 1) % PRIME
            power = power * BASE % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def _same(self, i: int, j: int, size: int) -> bool:
        sums, power = self.sums, self.powers[size]
        return (sums[i + size] - sums[i] * power - sums[j + size] + sums[j] * power) % PRIME == 0

    def _search(self, most: int, same) -> int:
        """The largest size up to most that is the same, found by doubling and halving."""
        if self.sums is None:
            self._hashes()
        low, step = 0, NEAR
        while low + step <= most and same(low + step):
            low += step
            step *= 2
        high = min(low + step, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if same(mid):
                low = mid
            else:
                high = mid
        return low

    def right(self, i: int, j: int) -> int:
        """Words equal from i and j on."""
        words, d = self.words, j - i
        low, high = self.known.get(d, (0, -1))
        if low <= i < high:
            return high - i
        most = low - i if i < low else self.n - j
        size = 0
        while size < most and size < NEAR and words[i + size] == words[j + size]:
            size += 1
        if size == NEAR:
            size = self._search(most, lambda k: self._same(i, j, k))
            if words[i : i + size] != words[j : j + size] or size < most and words[i + size] == words[j + size]:
                size = next((k for k in range(most) if words[i + k] != words[j + k]), most)  # the hashes erred
        end = high if i < low and i + size == low else i + size
        if size:
            self.known[d] = i, end
        return end - i

    def left(self, i: int, j: int) -> int:
        """Words equal before i and j."""
        words = self.words
        size = 0
        while size < i and size < NEAR and words[i - size - 1] == words[j - size - 1]:
            size += 1
        if size == NEAR:
            size = self._search(i, lambda k: self._same(i - k, j - k, k))
            if words[i - size : i] != words[j - size : j] or size < i and words[i - size - 1] == words[j - size - 1]:
                size = next((k for k in range(i) if words[i - k - 1] != words[j - k - 1]), i)
        return size


def stretch_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of word numbers."""
    n = len(words)
    ext = Extensions(words)
    found: set[tuple[int, int, int]] = set()
    for rising in (True, False):
        ends = [0] * n
        seen: dict[int, tuple[int, int]] = {}
        ext.known.clear()
        for i in range(n - 1, -1, -1):
            own, j = words[i], i + 1
            # the Lyndon word at i takes in those to its right while its suffix is the smaller one
            while j < n:
                if own == words[j]:
                    size = ext.right(i, j)
                    if j + size == n or (words[i + size] < words[j + size]) != rising:
                        break
                elif (own < words[j]) != rising:
                    break
                j = ends[j]
            ends[i] = j
            q = j - i
            if i + 2 * q > n or own != words[j]:
                continue
            low, high = seen.get(q, (0, -1))
            if low <= i and j <= high:
                continue
            start, end = i - ext.left(i, j), j + ext.right(i, j)
            seen[q] = start, end
            if end - start >= max(LEAST_LENGTH, LEAST_TIMES * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def likely_stretches(words: np.ndarray, borders: np.ndarray, most_rounds: int = 8) -> list[tuple[int, int]]:
    """Stretches of places, in order, outside of which no run has a place; words of text k are at borders[k] to borders[k + 1]."""
    starts, stops = borders[:-1], borders[1:]
    before = -1
    for _ in range(most_rounds):
        keep = stops - starts >= LEAST_LENGTH
        starts, stops = starts[keep], stops[keep]
        sizes = stops - starts
        if sizes.sum() == before or not len(sizes):
            break
        before = sizes.sum()
        part = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(before) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)
        own = words[at].astype(np.uint64)
        gram = part.astype(np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + np.roll(own, -k)
            gram ^= gram >> np.uint64(29)
        whole = np.flatnonzero(at + GRAM <= stops[part])
        order = whole[np.argsort(gram[whole], kind="stable")]
        near = (gram[order[1:]] == gram[order[:-1]]) & (part[order[1:]] == part[order[:-1]]) & (order[1:] - order[:-1] <= sizes[part[order[1:]]] // LEAST_TIMES)
        marks = np.zeros(before + GRAM, np.int32)
        again = np.unique(np.concatenate((order[1:][near], order[:-1][near])))
        marks[again] += 1
        marks[again + GRAM] -= 1
        held = np.cumsum(marks[:before]) > 0
        # a stretch ends where places are not held, or where another part begins
        first = held & ~np.concatenate(([False], held[:-1] & (part[1:] == part[:-1])))
        last = held & ~np.concatenate((held[1:] & (part[1:] == part[:-1]), [False]))
        starts, stops = at[first], at[last] + 1
    return list(zip(starts.tolist(), stops.tolist(), strict=True))


def texts_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    borders = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    words = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(borders[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in likely_stretches(words, borders):
        k = int(np.searchsorted(borders, a, "right")) - 1
        shift = a - int(borders[k])
        out[k] += [(s + shift, size, q) for s, size, q in stretch_runs(words[a:b].tolist())]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, size, q in runs:
        kept[start + q : start + size] = False
    return b" ".join(itertools.compress(words, kept.tolist()))


def split_rows(column: pa.Array) -> list[list[bytes]]:
    """The words of each text."""
    raw, ends = text_bytes(column)
    data, ends = raw.tobytes(), ends.tolist()
    return [data[a:b].split() for a, b in itertools.pairwise(ends)]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (array of start, length, period) and collapsed (text without the repeats) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for a, b in row_spans(batch.column(1), SPAN_BYTES):
                part = batch.slice(a, b - a)
                texts = split_rows(part.column(1))
                found = texts_runs(texts)
                left = pa.array([collapse(t, r) for t, r in zip(texts, found, strict=True)], pa.binary())
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), runs, left.cast(pa.string())], ["id", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.select(F.col("id").alias(id_col), "runs", "collapsed")


def longest(runs: str = "runs"):
    """Struct of start, length, period of the longest run: ties by start, then period; null if there is none."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the longest run, and digests of the runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("best")
    return (
        found.withColumn("best", longest())
        .withColumn("lines", F.array_join(line, ""))
        .select(
            *[c for c in found.columns if c not in ("runs", "collapsed")],
            F.size("runs").cast("bigint").alias("n_runs"),
            best["start"].alias("start"),
            best["length"].alias("length"),
            best["period"].alias("period"),
            F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
            F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


def plant(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose crc32 h of the id is divisible by 10 repeat a stretch of their words to the end.

    With g = h div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i from a on becomes word a + (i - a) mod p. Other
    rows, and those with a null id, stay as they are."""
    import zlib

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for a, b in row_spans(batch.column(1), SPAN_BYTES):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                for k, key in enumerate(part.column(0).to_pylist()):
                    if key is None or not texts[k] or (h := zlib.crc32(str(key).encode())) % 10:
                        continue
                    words, g = texts[k].encode().split(), h // 10
                    if words:
                        first = g % len(words)
                        p = 1 + (len(words) - first) // (3 + g % 8)
                        root = words[first : first + p]
                        texts[k] = b" ".join(words[:first] + [root[i % p] for i in range(len(words) - first)]).decode()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
