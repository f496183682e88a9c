"""A hidden Markov language model over whole corpora.

A text is its words and one end. Hidden states follow each other by a transition table; a state emits one of a fixed number of
buckets of words (by crc32; the end has its own), and a word has its share of its bucket, by the corpus-wide counts of all words:

    P(word | state) = P(bucket | state) * (c + 1) / (C + V + 1)

with c the count of the word, C and V the count and number of the bucket's words, and 1 for words not known. So what a state holds has a fixed size
whatever the corpus, while the counts are a table that grows with it. The transition table and the buckets of the states are learned by
Baum-Welch over all training texts: a task adds up expected counts over its texts (scaled forward and backward passes), Spark
adds those of all tasks by bucket. Scores come from the scaled forward recursion over the whole text; no path is left out.

Texts are read once, into blocks of bounded size: the distinct words of a block, and each token's place among them. Counts of a
block's words come from a join by word and go back to the block; texts are never gathered by word.

Defined results: a null text is empty and has only its end; A-Z are lower-cased, no other letters; words are separated by the bytes
0x20 and 0x09 to 0x0D; with nothing to learn from, all buckets and states are alike and no word is known; repeated rows count each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.arrow_text import row_spans, text_bytes
from crestline.llm.cut import cut

BUCKETS = 16_384
#: Text of a block, and tokens whose tables are held at once.
BLOCK_BYTES = 10_000_000
MOST_TOKENS = 200_000
#: The end of a text, as a word; words are never empty.
END = b""


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, plane by plane, so that the empty ones take no room."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block: ids, sizes (tokens) and learn of its texts, its words by falling use, their buckets and uses in learned texts, and all tokens."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        number = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        for batch in batches:
            for a, b in row_spans(batch.column(2), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                raw, ends = text_bytes(part.column(2))
                data = raw.tobytes().lower()
                known: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
                known[END]
                tokens, sizes = [], []
                for x, y in itertools.pairwise(ends.tolist()):
                    own = data[x:y].split()
                    own.append(END)
                    tokens.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
                    sizes.append(len(own))
                tokens = np.concatenate(tokens)
                order = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                words = list(known)
                words = [words[i] for i in order.tolist()]
                tokens = place[tokens]
                learned = part.column(1).to_numpy(zero_copy_only=False)
                uses = np.bincount(tokens[np.repeat(learned, sizes)], minlength=len(words))
                bucket = np.array([zlib.crc32(w) % (BUCKETS - 1) + 1 if w else 0 for w in words])
                packed = [zlib.compress(b"\n".join(words), 1), pack(bucket), pack(uses), pack(tokens)]
                alone = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(alone, part.column(0)), pa.ListArray.from_arrays(alone, pa.array(sizes, pa.int32())), pa.ListArray.from_arrays(alone, part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), *lists, *[pa.array([p], pa.binary()) for p in packed]], ["block", "ids", "sizes", "learn", "words", "buckets", "uses", "tokens"])

    return rows.mapInArrow(run, f"block bigint, ids array<{kind}>, sizes array<int>, learn array<boolean>, words binary, buckets binary, uses binary, tokens binary")


def block_words(table: DataFrame) -> DataFrame:
    """(block, place, word, n) for each distinct word of each block; n counts its uses in learned texts."""

    def run(batches):
        for batch in batches:
            for block, words, uses in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = pa.array(zlib.decompress(words).split(b"\n"), pa.binary()).cast(pa.string())
                size = len(words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.array(np.arange(size, dtype=np.int32)), words, pa.array(unpack(uses))], ["block", "place", "word", "n"])

    return table.select("block", "words", "uses").mapInArrow(run, "block bigint, place int, word string, n bigint")


def word_counts(words: DataFrame) -> DataFrame:
    """(word, n) of all words of learned texts."""
    return words.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """start: states; step: states by states; emit: buckets by states; count, kinds: uses and distinct words by bucket."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    count: np.ndarray
    kinds: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.count.sum())

    @property
    def words(self) -> int:
        return int(self.kinds.sum())


def first_model(count: np.ndarray, kinds: np.ndarray, states: int, seed: int) -> Model:
    """States that tend to stay, and differ by chance in how often they emit each bucket."""
    random = np.random.default_rng(seed)
    emit = ((count + 1) / (count + 1).sum())[:, None] * random.uniform(0.5, 1.5, (len(count), states))
    step = np.full((states, states), 0.01 / max(1, states - 1))
    np.fill_diagonal(step, 0.99 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0), count, kinds)


def by_length(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of texts by falling size, in parts of about most tokens or one text."""
    order = np.argsort(-sizes, kind="stable")
    upto = np.cumsum(sizes[order])
    start = 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield order[start:stop]
        start = stop


class Columns:
    """Texts of falling size, side by side: all first tokens, then all second ones, and so on; parts of these for a bounded number of tokens."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """codes of all tokens, and where texts of falling sizes start in them."""
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        self.offsets = np.concatenate(([0], np.cumsum(self.active)))
        text = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.codes = np.empty(len(text), np.int64)
        self.codes[self.offsets[step] + text] = codes[np.repeat(starts, sizes) + step]

    def parts(self, most: int) -> list[tuple[int, int]]:
        """Ranges of steps of about most tokens."""
        out, start = [], 0
        while start < len(self.active):
            stop = max(start + 1, int(np.searchsorted(self.offsets, self.offsets[start] + most, "right")) - 1)
            out.append((start, stop))
            start = stop
        return out

    def forward(self, model: Model, a: int, b: int, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Over steps a to b: emissions, scaled sums and their scales, and the states' shares before step b; ahead: those before step a."""
        first = self.offsets[a]
        emit = model.emit[self.codes[first : self.offsets[b]]]
        sums, scale = np.empty_like(emit), np.empty(len(emit))
        ones, step, at = np.ones(emit.shape[1]), model.step, 0
        for n in self.active[a:b].tolist():
            own = sums[at : at + n]
            np.multiply(ahead[:n], emit[at : at + n], out=own)
            np.dot(own, ones, out=scale[at : at + n])
            own /= scale[at : at + n, None]
            ahead = own @ step
            at += n
        return emit, sums, scale, ahead


def log_likelihoods(model: Model, codes: np.ndarray, sizes: np.ndarray, most: int = MOST_TOKENS) -> np.ndarray:
    """Log10 probability of each text's buckets, over all paths of states."""
    starts, out = np.cumsum(sizes) - sizes, np.zeros(len(sizes))
    for some in by_length(sizes, most):
        columns = Columns(codes, starts[some], sizes[some])
        ahead, logs = np.tile(model.start, (len(some), 1)), np.zeros(len(some))
        for a, b in columns.parts(most):
            _, _, scale, ahead = columns.forward(model, a, b, ahead)
            active = columns.active[a:b]
            text = np.arange(len(scale)) - np.repeat(np.cumsum(active) - active, active)
            logs += np.bincount(text, np.log10(scale), len(some))
        out[some] = logs
    return out


@dataclass
class Expected:
    """Expected counts: of first states, of steps, of buckets by state; and the log10 likelihood."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    log: float = 0.0


def expected_counts(model: Model, codes: np.ndarray, sizes: np.ndarray, most: int = MOST_TOKENS) -> Expected:
    """Sums over texts by forward and backward passes. Where a part of texts is longer than most tokens, only the states at
    the borders of ranges of steps are kept, and a range is walked again on the way back."""
    states = len(model.start)
    out = Expected(np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit))
    starts = np.cumsum(sizes) - sizes
    back = np.ascontiguousarray(model.step.T)
    for some in by_length(sizes, most):
        columns = Columns(codes, starts[some], sizes[some])
        parts = columns.parts(most)
        aheads = [np.tile(model.start, (len(some), 1))]
        for a, b in parts[:-1]:
            aheads.append(columns.forward(model, a, b, aheads[-1])[3])
        later = np.zeros((0, states))  # emission times backward share over scale, at the step after
        for (a, b), ahead in zip(reversed(parts), reversed(aheads), strict=True):
            emit, sums, scale, _ = columns.forward(model, a, b, ahead)
            out.log += float(np.log10(scale).sum())
            active = columns.active[a:b]
            emit /= scale[:, None]
            behind = np.ones_like(sums)
            at = len(sums)
            if len(later):
                last = sums[at - active[-1] :][: len(later)]
                out.step += last.T @ later
            for n in reversed(active.tolist()):
                at -= n
                own = behind[at : at + n]
                if len(later):
                    np.dot(later, back, out=own[: len(later)])
                later = emit[at : at + n]
                later *= own
            share = sums * behind
            for k in range(states):
                out.emit[:, k] += np.bincount(columns.codes[columns.offsets[a] : columns.offsets[b]], share[:, k], len(model.emit))
            if a == 0:
                out.start += share[: active[0]].sum(0)
            # each token with the one before it in its text
            own = np.arange(active[0], len(sums))
            out.step += sums[own - np.repeat(active[:-1], active[1:])].T @ emit[own]
    out.step *= model.step
    return out


def maximised(model: Model, got: Expected, smoothing: float) -> Model:
    """Shares from expected counts. A state's buckets are drawn to those of the corpus, by smoothing times as many uses as the state has buckets (Witten and
    Bell's rule), so that a state of few texts does not rule out what it has not seen; starts and steps get smoothing uses for all states."""
    states = len(model.start)
    flat = (model.count + 1) / (model.count + 1).sum()
    met = np.minimum(got.emit, 1).sum(0)
    emit = got.emit + smoothing * np.maximum(met, 1) * flat[:, None]
    step = got.step + smoothing / states
    start = got.start + smoothing / states
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0), model.count, model.kinds)


def fit(table: DataFrame, counts: DataFrame, *, states: int = 8, rounds: int = 4, rest: float = 1e-4, smoothing: float = 1.0, seed: int = 1, history: list[float] | None = None) -> Model:
    """Learn from the blocks of table, in rounds until the log likelihood gains less than a share of rest; the likelihood at the start of each round is added to history."""
    bucket = F.when(F.col("word") == "", 0).otherwise(F.crc32(F.col("word").cast("binary")) % (BUCKETS - 1) + 1)
    # one row for each bucket, whatever the corpus
    got = counts.groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    count, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    place = got["bucket"].to_numpy()
    count[place], kinds[place] = got["n"].to_numpy(), got["kinds"].to_numpy()
    model = first_model(count, kinds, states, seed)
    names = [f"s{k}" for k in range(states)]
    before = None
    for _ in range(rounds if count.sum() else 0):

        def run(batches, model=model):
            total = Expected(np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit))
            for batch in batches:
                for sizes, learn, buckets, tokens in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    sizes, learn = np.array(sizes, np.int64), np.array(learn, bool)
                    codes = unpack(buckets)[unpack(tokens)[np.repeat(learn, sizes)]]
                    if len(codes):
                        own = expected_counts(model, codes, sizes[learn])
                        total.start += own.start
                        total.step += own.step
                        total.emit += own.emit
                        total.log += own.log
            # buckets from 0 on, then -1: first states, -2 and below: steps from each state, and the likelihood in the row after
            met = np.flatnonzero(total.emit.any(1))
            keys = np.concatenate((met, -np.arange(1, states + 3)))
            values = np.concatenate((total.emit[met], total.start[None], total.step, np.full((1, states), total.log)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(values[:, k]) for k in range(states)]], ["key", *names])

        used = table.select("sizes", "learn", "buckets", "tokens")
        sums = used.mapInArrow(run, "key int, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        key, values = sums["key"].to_numpy(), np.stack([sums[n].to_numpy() for n in names], 1)
        at = {int(k): i for i, k in enumerate(key.tolist()) if k < 0}
        total = Expected(values[at[-1]], values[[at[-2 - k] for k in range(states)]], np.zeros_like(model.emit), float(values[at[-2 - states], 0]))
        total.emit[key[key >= 0]] = values[key >= 0]
        if history is not None:
            history.append(total.log)
        model = maximised(model, total, smoothing)
        if before is not None and total.log - before <= rest * abs(total.log):
            break
        before = total.log
    return model


def score(table: DataFrame, words: DataFrame, counts: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """id, learn, n_tokens, n_known, train_tokens, base_score (words alone) and score of every text, both log10."""
    met = words.select("block", "place", "word").join(counts, "word").groupBy("block").agg(F.collect_list(F.struct("place", "n")).alias("held"))
    rows = table.select("block", "ids", "sizes", "learn", "buckets", "tokens").join(met, "block", "left")
    kind = table.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        spread = np.log10(model.count + model.kinds + 1)
        flat = np.log10(model.tokens + model.words + 1)
        for batch in batches:
            for r in range(batch.num_rows):
                sizes = np.array(batch.column(2)[r].as_py(), np.int64)
                bucket, tokens = unpack(batch.column(4)[r].as_py()), unpack(batch.column(5)[r].as_py())
                known = np.zeros(len(bucket))
                held = batch.column(6)[r]
                if held.is_valid:
                    known[held.values.field(0).to_numpy()] = held.values.field(1).to_numpy()
                starts = np.cumsum(sizes) - sizes
                uses, own = np.log10(known + 1)[tokens], bucket[tokens]
                base = np.add.reduceat(uses, starts) - sizes * flat
                whole = log_likelihoods(model, own, sizes) + np.add.reduceat(uses - spread[own], starts)
                n_known = np.add.reduceat((known > 0)[tokens].astype(np.int64), starts)
                ids, learn = batch.column(1)[r].values, batch.column(3)[r].values
                yield pa.RecordBatch.from_arrays([ids, learn, pa.array(sizes), pa.array(n_known), pa.array(np.full(len(sizes), model.tokens)), pa.array(base), pa.array(whole)], ["id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = rows.mapInArrow(run, f"id {kind}, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return found.withColumnRenamed("id", id_col)


def score_texts(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", history: list[float] | None = None, **learning) -> DataFrame:
    """Learn from the rows of docs that learn holds for, and score all rows."""
    table = cut(blocks(docs, learn, id_col=id_col, text_col=text_col))
    words = block_words(table)
    counts = cut(word_counts(words))
    model = fit(table, counts, history=history, **learning)
    return score(table, words, counts, model, id_col=id_col)
