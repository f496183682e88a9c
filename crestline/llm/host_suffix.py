"""Main text of pages with a suffix array over each host.

A page is cut into blocks. The words of a host's pages are put end to end, for each page those of its contents and then those of
the elements that name themselves as something else (navigation, footers, adverts, comments, hidden parts), and a suffix array is sorted to the depth
`run` by prefix doubling. Neighbours whose longest common prefix reaches `run` words
form an interval; one with suffixes from at least `least_pages` pages of different contents is a repeated substring. Every
longer one is made of such, so what they cover is covered by the long repeated substrings, and a block
mostly covered is boilerplate. Words of contents and words of elements that name themselves are never the same word to the array, as
adverts quote articles.

The array decides first, over all blocks but those of an article element that holds at least half of the characters of the contents. That
is what the author set apart as the article; it stays, repeated or not, as articles share passages too. Of blocks that the
array leaves, those of elements that name themselves go, and so do those outside of a main element where there is one, those outside of such an
article where there is no main, and blocks outside of article and main whose text is more than half links. Blocks of links
go as repeated if any word is.

Rows travel once, by host. Hosts of more than `chunk_pages` pages are spread over parts of about that
size, and at most `chunk_pages` pages are worked on at a time, so memory is bounded whatever the size of a
host. A suffix array sees one such window; so the runs of a large host that the array is asked for
are first counted over the whole host: each as a 64-bit name with a 32-bit name of its page (runs
or pages that share a name by chance are taken for one), dealt by run, and those on enough pages are sent back to
the parts they occur in. The result thus does not depend on the windows.

Defined results: a null, empty or textless page has an empty text; a null url is a host of its
own; repeated rows are kept, and copies of a page count as one page for repetition; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.cut import cut
from crestline.llm.html_blocks import Block, blocks
from crestline.llm.shingles import ODD, mix, words

#: Characters of pages for each bucket of runs, and runs that are held before those on enough pages of a part are thinned out.
BUCKET_CHARS = 16_000_000
MOST_HELD = 4_000_000
#: Sets words of elements that name themselves apart from those of contents.
APART = np.uint64(0xD6E8FEB86659FD93)
#: Large hosts that are broadcast, at most, to the pages (a few MB).
MOST_HOSTS = 50_000


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first depth tokens, by prefix doubling."""
    n, length = len(tokens), 1
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while length < depth:
        step = min(length, depth - length)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        order = np.lexsort((later, rank))
        new = np.concatenate(([0], (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        length += step
    return order


def common_prefixes(tokens: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to most, of the longest common prefix of each suffix and the one before it in order; suffixes stop at ends."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(most):
        a, b = order[alive - 1] + k, order[alive] + k
        inside = (a < ends[order[alive - 1]]) & (b < ends[order[alive]])
        alive, a, b = alive[inside], a[inside], b[inside]
        alive = alive[tokens[a] == tokens[b]]
        out[alive] = k + 1
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, run: int, least_pages: int, counts_as: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a substring of at least `run` tokens that occurs on at least least_pages pages; substrings stay within a page.
    counts_as: for each token, the page that it is counted for, if that is another."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    ends = np.searchsorted(page, page, "right")
    counts_as = page if counts_as is None else counts_as
    pages = int(counts_as.max()) + 1
    order = suffix_array(tokens, run)
    order = order[order + run <= ends[order]]
    # an interval is a row of suffixes each of which shares run tokens with the one before it
    interval = np.cumsum(common_prefixes(tokens, ends, order, run) < run)
    often = np.bincount(np.unique(interval * pages + counts_as[order]) // pages)
    return under(order[often[interval] >= least_pages], n, run) if len(order) else np.zeros(n, bool)


def under(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n tokens lie in one of the runs that begin at starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    return np.cumsum(change[:-1]) > 0


def run_names(tokens: np.ndarray, page: np.ndarray, salts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs within a page, and a 64-bit name of each under its page's salt."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(run):
        total = total * ODD + tokens[k : k + n]
    starts = np.flatnonzero(page[run - 1 :] == page[:n])
    return starts, mix(total[starts] ^ mix(salts[page[starts]]))


def page_names(tokens: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A 32-bit name of the words of each page."""
    raw = tokens.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=4).digest(), "little") for a, b in zip(borders[:-1], borders[1:], strict=True)], np.uint64)


def thinned(pairs: np.ndarray, least_pages: int) -> np.ndarray:
    """Distinct rows of pairs (a run; its place and page in one number), of each run and place least_pages pages at most."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))] if len(pairs) else pairs
    place = pairs[:, 1] >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], (pairs[1:, 0] != pairs[:-1, 0]) | (place[1:] != place[:-1])))) if len(pairs) else np.zeros(0, np.int64)
    nth = np.arange(len(pairs)) - np.repeat(first, np.diff(np.append(first, len(pairs))))
    return pairs[nth < least_pages]


def often(pairs: np.ndarray, least_pages: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, runs), by place, of the runs that occur on at least least_pages pages of all places together."""
    page = pairs[:, 1] & np.uint64(0xFFFFFFFF)
    order = np.lexsort((page, pairs[:, 0]))
    run, page = pairs[order, 0], page[order]
    new = np.concatenate(([True], (run[1:] != run[:-1]) | (page[1:] != page[:-1])))
    names, count = np.unique(run[new], return_counts=True)
    kept = pairs[np.isin(pairs[:, 0], names[count >= least_pages])]
    both = np.unique(np.stack((kept[:, 1] >> np.uint64(32), kept[:, 0]), 1), axis=0)
    return both[:, 0].astype(np.uint32).view(np.int32), both[:, 1]


def settled(page: list[Block]) -> tuple[int | None, bool]:
    """The place of the article that holds at least half of the contents (None if none does), and whether any of these are left to the array."""
    main = in_main(page)
    asked = [b for b in page if b.place >= 0 and (not main or b.place & 1)]
    chars: dict[int, int] = {}
    for b in asked:
        chars[b.place] = chars.get(b.place, 0) + len(b.text)
    article = max((p for p in chars if p > 1), key=lambda p: (chars[p], -p), default=None)
    if article is not None and chars[article] * 2 < sum(chars.values()):
        article = None
    return article, bool(asked) if article is None else main and len(chars) > 1


def in_main(page: list[Block]) -> bool:
    return any(b.place > 0 and b.place & 1 for b in page)


def contents_first(page: list[Block]) -> list[Block]:
    return sorted(page, key=lambda b: b.place < 0)


def kept_blocks(page: list[Block], share: np.ndarray, most_covered: float) -> tuple[list[str], int, int]:
    """Texts of the blocks that stay, how many of the others went as repeated, and how many by markup; share: of the words of each block, covered by the array."""
    article, _ = settled(page)
    main = in_main(page)
    kept, removed, by_markup = [], 0, 0
    for b, covered in zip(page, share, strict=True):
        links = b.linked * 2 > len(b.text)
        if article is not None and b.place == article:
            kept.append(b.text)
        elif covered > (0 if links else most_covered):
            removed += 1
        elif b.place < 0 or (main and not b.place & 1) or (article is not None and not main) or (links and not b.place):
            by_markup += 1
        else:
            kept.append(b.text)
    return kept, removed, by_markup


def main_texts(pages: list[list[Block]], run: int, least_pages: int, most_covered: float, common: np.ndarray | None = None, salt: int = 0) -> list[tuple[str, int, int]]:
    """(text, blocks removed as repeated, and by markup) of each page of one host; common: names, under salt, of runs known to be repeated."""
    pages = [contents_first(p) for p in pages]
    flat = [b for p in pages for b in p]
    owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    article = [settled(p)[0] for p in pages]
    apart = np.array([b.place < 0 for b in flat], bool)
    asked = np.array([b.place != article[i] for b, i in zip(flat, owner, strict=True)], bool)
    row, tokens = words(pa.array([b.text for b in flat], pa.large_string()))
    page = owner[row] if len(row) else np.zeros(0, np.int64)
    # pages of the same contents count as one
    contents = ~apart[row]
    tokens[~contents] ^= APART
    borders = np.concatenate(([0], np.cumsum(np.bincount(page[contents], minlength=len(pages)))))
    own, names = tokens[contents], {}
    same = np.array([names.setdefault(own[a:b].tobytes(), len(names)) for a, b in zip(borders[:-1], borders[1:], strict=True)], np.int64)
    use = np.flatnonzero(asked[row])
    stream = 2 * page[use] + apart[row[use]]
    covered = np.zeros(len(tokens), bool)
    covered[use] = repeated(tokens[use], stream, run, least_pages, same[page[use]])
    if common is not None and len(common):
        starts, found = run_names(tokens[use], stream, np.full(2 * len(pages), salt, np.int64).view(np.uint64), run)
        covered[use] |= under(starts[np.isin(found, common)], len(use), run)
    total = np.bincount(row, minlength=len(flat))
    share = np.bincount(row, covered, minlength=len(flat)) / np.maximum(total, 1)
    out, k = [], 0
    for p in pages:
        kept, *gone = kept_blocks(p, share[k : k + len(p)], most_covered)
        out.append(("\n".join(kept), *gone))
        k += len(p)
    return out


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = 8, least_pages: int = 3, most_covered: float = 0.8, chunk_pages: int = 256) -> DataFrame:
    """id, url, text, n_chars, n_repeated (blocks removed as boilerplate of the host) and n_markup (blocks that went by markup, as the array left them) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))

    # at most one host for each chunk_pages pages
    counts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))
    large = cut(counts.where(F.col("n") > chunk_pages).select("host", F.ceil(F.col("n") / chunk_pages).alias("parts"), "chars"))
    hosts, chars = large.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    sizes = large.drop("chars")
    id_type = rows.schema["id"].dataType.simpleString()
    placed = rows.join(F.broadcast(sizes) if hosts <= MOST_HOSTS else sizes, "host", "left").withColumn("order", F.xxhash64("id", "url"))
    placed = placed.withColumn("part", F.pmod("order", F.coalesce("parts", F.lit(1)))).withColumn("place", F.hash("host", "part")).withColumn("salt", F.xxhash64("host"))

    def parse(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [contents_first(blocks(x or "", apart=True)) for x in part.column(6).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:6], pa.array(["\n".join(b.text for b in x) for x in found], pa.string()), pa.array([[b.place for b in x] for x in found], pa.list_(pa.int32())), pa.array([[b.linked for b in x] for x in found], pa.list_(pa.int32())), pa.nulls(part.num_rows, pa.binary())],
                    ["id", "url", "place", "salt", "part", "order", "blocks", "places", "linked", "runs"],
                )

    def list_runs(batches, buckets):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                texts, contents = [], []
                for x in part.column(2).to_pylist():
                    found = blocks(x or "", apart=True)
                    article, _ = settled(found)
                    contents.append("\n".join(b.text for b in found if b.place >= 0))
                    texts += ["\n".join(b.text for b in found if b.place >= 0 and b.place != article), "\n".join(b.text for b in found if b.place < 0)]
                page, tokens = words(pa.array(contents, pa.large_string()))
                own = page_names(tokens, np.searchsorted(page, np.arange(len(contents) + 1)))
                stream, tokens = words(pa.array(texts, pa.large_string()))
                tokens[stream % 2 == 1] ^= APART
                starts, names = run_names(tokens, stream, np.repeat(part.column(1).to_numpy().view(np.uint64), 2), run)
                where = part.column(0).to_numpy().view(np.uint32).astype(np.uint64) << np.uint64(32) | own
                pairs = thinned(np.stack((names, where[stream[starts] // 2]), 1), least_pages)
                bucket = (pairs[:, 0] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                pairs, (own, first) = pairs[order], np.unique(bucket[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([p.tobytes() for p in np.split(pairs, first[1:])] if len(own) else [], pa.binary())], ["bucket", "pairs"])

    def count_runs(batches):
        now, held, n = None, [], 0

        def done():
            places, names = often(thinned(np.concatenate(held), least_pages), least_pages)
            own, first = np.unique(places, return_index=True)
            order = np.argsort(first)
            return pa.RecordBatch.from_arrays([pa.array(own[order], pa.int32()), pa.array([x.tobytes() for x in np.split(names, first[order][1:])] if len(own) else [], pa.binary())], ["place", "runs"])

        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and bucket != now:
                    yield done()
                    held, n = [], 0
                now = bucket
                held.append(np.frombuffer(raw.as_py(), np.uint64).reshape(-1, 2))
                n += len(held[-1])
                if n > MOST_HELD and len(held) > 1:
                    held = [thinned(np.concatenate(held), least_pages)]
                    n = len(held[0]) // 2  # what stays counts half, so that it is not gone over for each row
        if held:
            yield done()

    columns = ["id", "url", "place", "salt", "part", "order"]
    dealt = placed.select(*columns, "html").mapInArrow(parse, f"id {id_type}, url string, place int, salt bigint, part bigint, order bigint, blocks string, places array<int>, linked array<int>, runs binary")
    if chars:
        buckets = -(-chars // BUCKET_CHARS)
        listed = placed.where("parts is not null").select("place", "salt", "html").mapInArrow(lambda x: list_runs(x, buckets), "bucket bigint, pairs binary")
        known = listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count_runs, "place int, runs binary")
        dealt = dealt.unionByName(known, allowMissingColumns=True)
    # the runs of a place come before its pages
    dealt = dealt.repartition("place").sortWithinPartitions("place", F.col("runs").isNull(), "salt", "part", "order")

    def work(batches):
        held: list[tuple] = []

        def done():
            pages_of = [[Block(*b) for b in zip(r["blocks"].split("\n"), r["places"], r["linked"], strict=True)] if r["blocks"] else [] for r in held]
            texts = main_texts(pages_of, run, least_pages, most_covered, common, held[0]["salt"])
            return pa.RecordBatch.from_arrays(
                [pa.array([r["id"] for r in held], id_arrow), pa.array([r["url"] for r in held], pa.string()), pa.array([t[0] for t in texts], pa.string()), pa.array([len(t[0]) for t in texts], pa.int64()), pa.array([t[1] for t in texts], pa.int64()), pa.array([t[2] for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars", "n_repeated", "n_markup"],
            )

        group = place = id_arrow = None
        known: list[np.ndarray] = []
        common = None
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for a in range(0, batch.num_rows, 512):
                for r in batch.slice(a, 512).to_pylist():
                    if held and ((r["place"], r["salt"], r["part"]) != group or len(held) >= chunk_pages):
                        yield done()
                        held.clear()
                    if r["place"] != place:
                        place, known, common = r["place"], [], None
                    if r["runs"] is not None:
                        known.append(np.frombuffer(r["runs"], np.uint64))
                        continue
                    if known:
                        common, known = np.concatenate(known), []
                    group = (r["place"], r["salt"], r["part"])
                    held.append(r)
        if held:
            yield done()

    out = dealt.mapInArrow(work, f"id {id_type}, url string, text string, n_chars bigint, n_repeated bigint, n_markup bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_repeated", "n_markup")
