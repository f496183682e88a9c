"""Benchmark decontamination with the q-gram lemma over diagonal bands.

Texts are folded: lower case, every run of other characters one space. A benchmark
item is cut into overlapping segments of `width` characters, one every width // 8 (a shorter item is one
segment), so a passage of width + width // 8 - 1 characters always holds one: of 71, as set here. A segment of length m within e edits of some part of a document shares at
least m + 1 - q (e + 1) q-grams with it, all on few neighbouring diagonals. So hits of
benchmark q-grams are counted in overlapping diagonal bands per document and item, bands and
then segments that reach the bound are kept, and banded alignment verifies them. The edit
budget of a segment is one edit in `per_edit` characters. An item of fewer than `least_chars` characters is
sought whole and without edits, between word borders, if it has `least_short` letters; letters of scripts
that write words without spaces count twice, and have a border on each side.

The benchmark is a stated query set: it is taken in blocks of about `block_bytes` of text. What is sent to the
executors is a block's texts and nothing else, so that size bounds the broadcast, and each Python process makes the index of
one block at a time from them (some 45 bytes a character). Each document is read whole and on its own, once a block; its
pairs of a hit and a place in the benchmark are worked on PAIRS at a time, each lot with the hits that a segment begun in it may
reach, so that memory does not grow with texts or items that repeat the same q-grams. Of the places of a segment
the one with the most hits is verified first, and the others only while edits remain.

Defined results: null or empty texts match nothing, nor do items of fewer than
`least_short` letters, as these are words of any text; repeated rows match each by itself; repeated items
give one row each id; empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.arrow_text import row_spans

SPACE = 32
SPAN_BYTES = 2_000_000
#: Pairs of a hit and a place in the benchmark that are held at once.
PAIRS = 1 << 20
#: Scripts without spaces between words: Thai to Lao, Burmese, Khmer, Han with kana, and further Han.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def fold_table() -> np.ndarray:
    """The folded form of each code point: a letter or digit in lower case, else a space."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalnum() else SPACE for c in range(0x110000)], np.uint32)


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts end to end, each between spaces; row borders; places in the own text."""
    joined = "\n".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    folded = fold_table()[codes] if len(codes) else codes
    kept = np.ones(len(folded), bool)
    kept[1:] = (folded[1:] != SPACE) | (folded[:-1] != SPACE)
    # the line break between two texts stays, so no run reaches across
    breaks = starts[1:] - 1
    kept[breaks] = True
    at = np.flatnonzero(kept)
    borders = np.concatenate((np.searchsorted(at, starts), [len(at)]))
    out = folded[at]
    out[np.searchsorted(at, breaks)] = 0
    return out, borders, at - np.repeat(starts, np.diff(borders))


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place, by doubling."""
    power, done, span = codes.astype(np.uint64), None, 1
    left, covered = q, 0
    factor = MULTIPLIER
    while left:
        if left & 1:
            if done is None:
                done, covered = power, span
            else:
                n = len(power) - covered
                done = done[:n] * factor + power[covered : covered + n] if n > 0 else power[:0]
                covered += span
        left >>= 1
        if left:
            n = len(power) - span
            power = power[:n] * factor + power[span:] if n > 0 else power[:0]
            span *= 2
            factor = np.uint64(int(factor) ** 2 % (1 << 64))
    h = done
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def unspaced(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), bool)
    for a, b in UNSPACED:
        out |= (codes >= a) & (codes < b)
    return out


class Index:
    """q-grams of some benchmark items, and their segments."""

    def __init__(self, items: list[tuple], q: int, width: int, per_edit: int, least_chars: int, least_short: int = 12):
        self.q = q
        self.ids: list = []
        texts: list[str] = []
        self.codes: list[np.ndarray] = []
        short: list[tuple] = []
        for item_id, text in items:
            codes = fold([text])[0]
            codes = codes[int(len(codes) > 0 and codes[0] == SPACE) :]
            codes = codes[: len(codes) - int(len(codes) > 0 and codes[-1] == SPACE)]
            if len(codes) >= max(least_chars, q):
                self.ids.append(item_id)
                self.codes.append(codes)
                texts.append(text)
            elif len(codes) + unspaced(codes).sum() >= least_short:
                short.append((item_id, codes))
        # short items come behind the others, by the length of the gram that they begin with
        self.short: dict[int, tuple[np.ndarray, list[list[tuple[int, np.ndarray]]]]] = {}
        for n in {min(len(c), q) for _, c in short}:
            held: dict[int, list] = {}
            for i, (_, c) in enumerate(short, len(self.ids)):
                if min(len(c), q) == n:
                    held.setdefault(int(gram_hashes(c[:n], n)[0]), []).append((i, c))
            self.short[n] = (np.array(sorted(held), np.uint64), [held[k] for k in sorted(held)])
        self.ids += [i for i, _ in short]
        self.segments: list[list[tuple[int, int]]] = []
        #: How many segments of the item read like each of these.
        self.copies: list[list[int]] = []
        grams, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, c in enumerate(self.codes):
            n, w = len(c), min(width, len(c))
            alike: dict[bytes, list[int]] = {}
            for b in sorted({*range(0, n - w + 1, max(1, w // 8)), n - w}):
                alike.setdefault(c[b : b + w].tobytes(), []).append(b)
            self.segments.append([(x[0], w) for x in alike.values()])
            self.copies.append([len(x) for x in alike.values()])
            # only places within these segments are looked up
            wanted = np.unique(np.concatenate([np.arange(b, b + w - q + 1) for b, w in self.segments[-1]]))
            grams.append(gram_hashes(c, q)[wanted])
            item.append(np.full(len(wanted), i))
            place.append(wanted)
        flat, item, place = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
        order = np.argsort(flat, kind="stable")
        self.keys, first, often = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.often, self.item, self.place = (x.astype(np.int32) for x in (first, often, item[order], place[order]))
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.keys)) * 16))))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True
        self.begins = [np.array([b for b, _ in s]) for s in self.segments]
        self.per_edit = per_edit
        self.most = max((self.budget(w) for s in self.segments for _, w in s), default=0)
        self.least = min((self.bound(w) for s in self.segments for _, w in s), default=1)
        self.budgets = {w: self.budget(w) for s in self.segments for _, w in s}
        self.longest = max(map(len, self.codes), default=0)

    def budget(self, m: int) -> int:
        """Edits allowed in a segment of m characters, so that at least one q-gram must be shared."""
        return max(0, min(m // self.per_edit, (m - self.q) // self.q))

    def bound(self, m: int) -> int:
        return max(1, m + 1 - self.q * (self.budget(m) + 1))


def aligned(segment: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Fewest edits that turn segment (one for all windows, or a row for each) into some part of each window, on the diagonals that a window longer than segment leaves."""
    segment = np.atleast_2d(segment)
    n, m = len(windows), segment.shape[1]
    band = windows.shape[1] - m + 1
    across = np.arange(band)
    cost = np.zeros((n, band), np.int32)
    for i in range(m):
        new = cost + (windows[:, i : i + band] != segment[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - across, 1) + across
        if i % 16 == 15 and not (cost.min(1) <= most).any():
            break
    return cost.min(1)


def window_names(segment: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A 64-bit name for each segment with its window."""
    both = np.concatenate((segment, windows), 1)
    draw = np.random.default_rng(both.shape[1]).integers(0, 1 << 63, both.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    x = both.astype(np.uint64)
    x = (x ^ (x << np.uint64(21)) ^ (x << np.uint64(42))) * draw
    return ((x ^ (x >> np.uint64(29))) * MULTIPLIER).sum(1, dtype=np.uint64)


def search(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, segments, fewest edits, start, end) for each item found in a text; start and end are places in the text."""
    if not texts or not index.ids:
        return []
    codes, borders, places = fold(texts)
    return sorted(parts_found(codes, borders, places, index) + whole_found(codes, borders, places, index))


def whole_found(codes: np.ndarray, borders: np.ndarray, places: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """What search tells of short items: those held whole, between word borders."""
    if not index.short:
        return []
    loose = (codes <= SPACE) | unspaced(codes)
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = loose[1:] | loose[:-1]
    begins = np.flatnonzero(edge[:-1] & (codes > SPACE))
    spans: dict[tuple[int, int], list] = {}
    for n, (keys, items) in index.short.items():
        at = begins[begins <= len(codes) - n]
        if not len(at):
            continue
        hashes = gram_hashes(codes, n)[at]
        found = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        right = keys[found] == hashes
        at, found = at[right], found[right]
        for k in np.unique(found):
            for item, own in items[k]:
                m = len(own)
                some = at[found == k]
                some = some[some <= len(codes) - m]
                some = some[edge[some + m]]
                some = some[(codes[some[:, None] + np.arange(m)] == own).all(1)]
                for row, a in zip(np.searchsorted(borders, some, "right") - 1, some, strict=True):
                    last = min(a + m, borders[row + 1] - 1)
                    spans.setdefault((int(row), item), []).append((int(places[a]), int(places[last])))
    return [(r, i, 1, 0, min(a for a, _ in x), max(b for _, b in x)) for (r, i), x in spans.items()]


def parts_found(codes: np.ndarray, borders: np.ndarray, places: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """What search tells of items that are sought in segments; start and end span the best place of each segment found, the first of equals."""
    if len(codes) < index.q or not len(index.keys):
        return []
    hashes = gram_hashes(codes, index.q)
    at = np.flatnonzero(index.seen[(hashes >> index.shift).astype(np.int64)])
    found = np.searchsorted(index.keys, hashes[at])
    found = np.minimum(found, len(index.keys) - 1)
    right = index.keys[found] == hashes[at]
    at, found = at[right], found[right]
    row = np.searchsorted(borders, at, "right") - 1
    # a band needs `least` hits within a segment's reach: drop hits that have too few others near
    near = max((w for s in index.segments for _, w in s), default=0) + index.most
    crowd = np.searchsorted(at, at + near, "right") - np.searchsorted(at, at - near)
    at, found, row = at[crowd >= index.least], found[crowd >= index.least], row[crowd >= index.least]
    if not len(at):
        return []
    matches: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
    done: set[int] = set()
    weight = np.cumsum(index.often[found], dtype=np.int64)
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(weight, (weight[start - 1] if start else 0) + PAIRS, "right")))
        reach = int(np.searchsorted(at, at[stop - 1] + near, "right"))
        wanted = candidates(at[start:reach], found[start:reach], row[start:reach], index, np.array(sorted(done), np.int64))
        verify(wanted, codes, borders, places, index, near, matches)
        for (r, i), m in matches.items():
            if len(m) == len(index.segments[i]) and not any(e for e, _, _ in m.values()):
                done.add(r * len(index.ids) + i)
        start = stop
    return [(r, i, sum(index.copies[i][s] for s in m), min(x[0] for x in m.values()), min(x[1] for x in m.values()), max(x[2] for x in m.values())) for (r, i), m in sorted(matches.items())]


def candidates(at: np.ndarray, found: np.ndarray, row: np.ndarray, index: Index, done: np.ndarray) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    """For each (row, item, segment) that may be in a text, the (less hits, lowest diagonal) of the bands that reach its bound; done: rows and items that need no more."""
    often = index.often[found]
    hit = np.repeat(np.arange(len(at)), often)
    post = np.repeat(index.first[found], often) + np.arange(len(hit)) - np.repeat(np.cumsum(often) - often, often)
    item = index.item[post].astype(np.int64)
    left = ~np.isin(row[hit] * len(index.ids) + item, done)
    hit, post, item = hit[left], post[left], item[left]
    if not len(hit):
        return {}
    inside, step = index.place[post].astype(np.int64), index.most + 1
    band = (at[hit] - inside + index.longest) // step
    bands = int(band.max()) + 2
    # each hit counts in the band that starts at its own step and in the one before: bands are two steps wide
    base = (row[hit] * len(index.ids) + item) * bands + band
    key = np.concatenate((base + 1, base))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(sorted_key)])))
    kept = sizes >= index.least
    out: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for a, size in zip(starts[kept], sizes[kept], strict=True):
        own = order[a : a + size] % len(base)
        value = int(sorted_key[a])
        low = (value % bands - 1) * step - index.longest
        the_row, the_item = divmod(value // bands, len(index.ids))
        spots = np.sort(inside[own])
        begin, w = index.begins[the_item], index.segments[the_item][0][1]
        held = np.searchsorted(spots, begin + w - index.q, "right") - np.searchsorted(spots, begin)
        for s in np.flatnonzero(held >= index.bound(w)):
            out.setdefault((the_row, the_item, int(s)), []).append((-int(held[s]), low))
    return out


def verify(wanted: dict, codes: np.ndarray, borders: np.ndarray, places: np.ndarray, index: Index, near: int, matches: dict) -> None:
    """Add to matches the segments that align within their budget, as segment -> (edits, start, end) by row and item."""
    step, shift = index.most + 1, 4 * (index.most + 1) + near
    padded = np.concatenate((np.zeros(shift, np.uint32), codes, np.zeros(shift + near, np.uint32)))
    # first the band with the most hits of each segment, then the others of those that still have edits
    first = [(*k, min(v)[1]) for k, v in wanted.items()]
    others = [(*k, low) for k, v in wanted.items() for best in (min(v),) for less, low in v if (less, low) != best]
    for some in (first, others):
        by_width: dict[int, list] = {}
        for r, i, s, low in some:
            if matches.get((r, i), {}).get(s, (1,))[0]:
                by_width.setdefault(index.segments[i][0][1], []).append((r, i, s, low))
        for w, spots in by_width.items():
            most, wide = index.budgets[w], w + 2 * step + 2 * index.budgets[w]
            for part in range(0, len(spots), 4096):
                lot = spots[part : part + 4096]
                segment = np.stack([index.codes[i][index.begins[i][s] :][:w] for _, i, s, _ in lot])
                begins = np.array([low + index.begins[i][s] - most for _, i, s, low in lot])
                windows = padded[np.clip(begins + shift, 0, len(padded) - wide)[:, None] + np.arange(wide)]
                # what lies in another text does not count
                where = begins[:, None] + np.arange(wide)
                rows = np.array([r for r, _, _, _ in lot])
                windows = np.where((where >= borders[rows][:, None]) & (where < borders[rows + 1][:, None]), windows, 0)
                # alike segments and windows, as repetitive texts have them, are aligned once
                names = window_names(segment, windows)
                _, one, back = np.unique(names, return_index=True, return_inverse=True)
                edits = aligned(segment[one], windows[one], most)[back]
                for (r, i, s, _), b, e in zip(lot, begins, edits, strict=True):
                    if e <= most:
                        low = min(max(b + most, borders[r]), borders[r + 1] - 1)
                        high = min(max(b + most + w + step, borders[r]), borders[r + 1] - 1)
                        here = (int(e), int(places[low]), int(places[high]))
                        own = matches.setdefault((r, i), {})
                        own[s] = min(own.get(s, here), here)


OPTIONS = {"q": 12, "width": 64, "per_edit": 16, "least_chars": 40, "least_short": 12}


@functools.lru_cache(1)
def _index(block: tuple, options: tuple) -> Index:
    return Index(list(block), **dict(options))


def sent_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int):
    """The benchmark in broadcast blocks of about block_bytes, each as a tuple of (item, text)."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // block_bytes) or 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = part.distinct().orderBy("item", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(tuple((r.item, r.text) for r in rows))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4_000_000, **options) -> DataFrame:
    """A row for each document and item found in it: id, item id, n_segments found, edits (fewest in a segment), and
    start and end, about where in the text the passage lies. options: q, width, per_edit, least_chars, least_short."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
    result = None
    chosen = tuple(sorted((OPTIONS | options).items()))
    for sent in sent_blocks(benchmark, item_col, item_text_col, block_bytes):

        def run(batches, sent=sent):
            index = _index(sent.value, chosen)
            for batch in batches:
                for a, b in row_spans(batch.column(1), SPAN_BYTES):
                    some = batch.slice(a, b - a)
                    got = search(some.column(1).to_pylist(), index)
                    columns = list(zip(*got, strict=True)) if got else [()] * 6
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(pa.array(columns[0], pa.int64())), pa.array([index.ids[i] for i in columns[1]], item_type), *(pa.array(c, pa.int64()) for c in columns[2:])],
                        ["id", "item", "n_segments", "edits", "start", "end"],
                    )

        found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, item {item_kind}, n_segments bigint, edits bigint, start bigint, end bigint")
        result = found if result is None else result.unionByName(found)
    return result.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_segments", "edits", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4_000_000, **options) -> DataFrame:
    """The rows of docs in which nothing of the benchmark is found, each judged where it is: no shuffle."""
    chosen = tuple(sorted((OPTIONS | options).items()))
    for sent in sent_blocks(benchmark, item_col, item_text_col, block_bytes):
        place = docs.columns.index(text_col)

        def run(batches, sent=sent, place=place):
            index = _index(sent.value, chosen)
            for batch in batches:
                for a, b in row_spans(batch.column(place), SPAN_BYTES):
                    some = batch.slice(a, b - a)
                    kept = np.ones(some.num_rows, bool)
                    kept[[r[0] for r in search(some.column(place).to_pylist(), index)]] = False
                    yield some.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
