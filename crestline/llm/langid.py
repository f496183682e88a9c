"""Language identification with segmentation-marginalised unigrams.

The vocabulary is a fixed public one: its pieces of letters, in lower case and those that become alike taken for one, a mark
before those that begin a word. A language gives each piece a probability. The probability of
a word is the sum over all ways to cut it into pieces, which a forward pass
yields; a text's score is the sum over its words of their logs, plus the log share of the language
among the documents learned from. Words of all documents are counted by language, in Spark; probabilities are then
learned from these counts by expectation and maximisation, from equal piece probabilities on, until the likelihood rests: each
round adds up expected counts of pieces (forward and backward passes) per task and then by Spark, so what comes to the driver is one number for each
language and piece. Passes run over the distinct words of a batch at once.

Defined results: a word is a run of letters (`str.isalpha`), of any length; a null text, or one without a letter, is `und` with score 0;
documents with null lang teach nothing; with no language learned every text is
`und`; ties go to the first language by name; repeated rows count each time; letters outside the
vocabulary have a small fixed probability; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.arrow_text import row_spans
from crestline.llm.cut import cut
from crestline.llm.token_counts import vocabulary_path

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
#: Characters that count as word characters for `re` but are neither letters nor decimal digits, such as superscripts and fractions.
NUMBERS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
SPAN_BYTES = 4_000_000
#: Places that the tables of a pass hold at once, over all languages or piece lengths.
MOST_CELLS = 4_000_000
#: Index of the piece for any other letter, and of no piece.
OTHER, NONE = 0, 1


def letter_runs(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ([w] if w.isalpha() else NUMBERS.sub(" ", w).split())]


class Trie:
    """Pieces as a table of steps: state, letter -> state; state 0 is dead, 1 the root."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces if len(p) > 1 for c in p} | {MARK})
        self.letter = np.zeros(0x110000, np.int16)  # 0: in no longer piece
        for i, c in enumerate(letters, 1):
            self.letter[ord(c)] = i
        self.alone = {ord(p): i for i, p in enumerate(pieces, 2) if len(p) == 1}
        steps: list[dict[int, int]] = [{}, {}]
        ends = {}
        for i, p in enumerate(pieces, 2):
            state = 1
            if len(p) == 1 and not self.letter[ord(p)]:
                continue
            for c in p:
                k = int(self.letter[ord(c)])
                if k not in steps[state]:
                    steps[state][k] = len(steps)
                    steps.append({})
                state = steps[state][k]
            ends[state] = i
        self.steps = np.zeros((len(steps), len(letters) + 1), np.int32)
        for s, to in enumerate(steps):
            for k, v in to.items():
                self.steps[s, k] = v
        self.piece = np.full(len(steps), NONE, np.int32)
        for s, i in ends.items():
            self.piece[s] = i
        self.size = len(pieces) + 2
        self.longest = max(map(len, pieces), default=1)
        single = np.full(0x110000, OTHER, np.int32)
        for c, i in self.alone.items():
            single[c] = i
        self.single = single


@functools.cache
def trie(vocabulary: str) -> Trie:
    """The pieces of letters of a sentencepiece model; built once in a process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
    found = set()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower()
        bare = p.removeprefix(MARK)
        if bare.isalpha() or p == MARK:
            found.add(p)
    return Trie(sorted(found | {MARK}))


def by_length(words: list[str], most_cells: int, rows: int = 20_000):
    """Places of words and their code points with the mark before, as tables of words of like length, of about most_cells or one word."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        first = len(words[order[start]])
        stop = start
        cells = 0
        while stop < len(order) and stop - start < rows and len(words[order[stop]]) <= first + 3 + first // 8 and cells < most_cells:
            cells += len(words[order[stop]]) + 1
            stop += 1
        some = order[start:stop]
        width = len(words[some[-1]]) + 1
        text = "".join(MARK + words[i].ljust(width - 1, "\0") for i in some)
        yield np.array(some), np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), width), np.array([len(words[i]) + 1 for i in some])
        start = stop


def walk(t: Trie, codes: np.ndarray, letters: np.ndarray, i: int):
    """(length, piece of each word) for the pieces that start at place i."""
    state = np.ones(len(codes), np.int32)
    for k in range(1, min(t.longest, codes.shape[1] - i) + 1):
        state = t.steps[state, letters[:, i + k - 1]]
        piece = t.piece[state]
        if k == 1:
            piece = np.where(piece == NONE, t.single[codes[:, i]], piece)
        elif not state.any():
            return
        yield k, piece


def log_words(t: Trie, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word by column of probabilities (pieces by languages), over all segmentations."""
    out = np.zeros((len(words), probabilities.shape[1]))
    for some, codes, sizes in by_length(words, MOST_CELLS // max(1, probabilities.shape[1])):
        n, width = codes.shape
        letters = t.letter[codes]
        forward = np.zeros((width + 1, n, probabilities.shape[1]))
        forward[0] = 1
        logs = np.zeros((n, probabilities.shape[1]))
        done = np.zeros_like(logs)
        for i in range(width):
            if i % 16 == 0 and i:
                # all later sums start from the last few places: scale these together
                scale = np.maximum(forward[i : i + t.longest + 1].max(0), 1e-300)
                forward[i : i + t.longest + 1] /= scale
                logs += np.log(scale)
            for k, piece in walk(t, codes, letters, i):
                forward[i + k] += forward[i] * probabilities[piece]
            over = sizes == i + 1
            if over.any():
                done[over] = np.log(np.maximum(forward[i + 1][over], 1e-300)) + logs[over]
        out[some] = done
    return out


def flat_pieces(t: Trie) -> np.ndarray:
    """Equal probabilities of all pieces, and a small one of any other letter."""
    flat = np.full(t.size, 1 / t.size)
    flat[NONE], flat[OTHER] = 0, 1e-6
    return flat


def expected_pieces(t: Trie, words: list[str], weight: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected number of uses of each piece in words that occur weight times, under the probabilities p, and the log likelihood of all words.

    Sums are scaled at every 16th place, so words may be of any length: the true forward sum of place j is forward[j] times the
    scales at places up to j, the backward sum has those at places from j on."""
    total, likelihood = np.zeros(t.size), 0.0
    for some, codes, sizes in by_length(words, MOST_CELLS // t.longest):
        n, width = codes.shape
        letters = t.letter[codes]
        found = [list(walk(t, codes, letters, i)) for i in range(width)]
        forward, backward = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        ahead, behind = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        forward[0] = 1
        for i in range(width):
            if i % 16 == 0 and i:
                scale = np.maximum(forward[i : i + t.longest + 1].max(0), 1e-300)
                forward[i : i + t.longest + 1] /= scale
                ahead[i:] += np.log(scale)
            for k, piece in found[i]:
                forward[i + k] += forward[i] * p[piece]
        backward[sizes, np.arange(n)] = 1
        for i in reversed(range(width)):
            if i % 16 == 0 and i + 1 < width:
                part = backward[i + 1 : i + t.longest + 2]
                scale = part.max(0)
                scale = np.where(scale > 0, scale, 1)
                part /= scale
                behind[: i + 1 + len(part)] += np.log(scale)
            for k, piece in found[i]:
                backward[i] += backward[i + k] * p[piece] * (i + k <= sizes)
        whole = np.log(np.maximum(backward[0], 1e-300)) + behind[0]
        likelihood += float((whole * weight[some]).sum())
        for i in range(width):
            for k, piece in found[i]:
                share = forward[i] * p[piece] * backward[i + k] * np.exp(np.minimum(ahead[i] + behind[i + k] - whole, 700))
                total += np.bincount(piece, share * weight[some], t.size)
    total[NONE] = 0
    return total, likelihood


@dataclass(frozen=True)
class LanguageModel:
    """probabilities: pieces by languages; prior: log share of documents."""

    names: list[str]
    probabilities: np.ndarray
    prior: np.ndarray


def count_words(rows: DataFrame, most_words: int = 400_000) -> DataFrame:
    """(lang, word, n) of rows (lang, text), and a row with a null word for the number of documents of each language."""

    def run(batches):
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for a, b in row_spans(batch.column(1), SPAN_BYTES):
                part = batch.slice(a, b - a)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts = held.setdefault(lang, Counter())
                    counts[None] += 1
                    counts.update(letter_runs(text))
                if sum(map(len, held.values())) > most_words:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def maximised(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Probabilities from expected counts (pieces by languages)."""
    counts = counts + smoothing
    counts[NONE] = 0
    found = counts / counts.sum(0)
    found[OTHER] = np.minimum(found[OTHER], 1e-5)
    return found


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", vocabulary: str = DEFAULT_VOCABULARY, smoothing: float = 0.1, rounds: int = 8, rest: float = 2e-3, history: list[float] | None = None) -> LanguageModel:
    """Learn from every row whose lang is not null, in rounds until the log likelihood gains less than a share of rest;
    the likelihood at the start of each round is added to history."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = cut(count_words(rows))
    documents = {r.lang: r.n for r in counted.where("word is null").collect()}
    names = sorted(documents)
    place = {lang: i for i, lang in enumerate(names)}
    words, t = counted.where("word is not null"), trie(vocabulary)
    probabilities = np.tile(flat_pieces(t)[:, None], (1, len(names)))
    before = None
    for _ in range(rounds if names else 0):

        def run(batches, now=probabilities):
            t = trie(vocabulary)
            sums, logs = np.zeros((t.size, len(names))), 0.0
            for batch in batches:
                for a in range(0, batch.num_rows, 100_000):
                    part = batch.slice(a, 100_000)
                    langs = np.array([place[x] for x in part.column(0).to_pylist()])
                    own, n = part.column(1), part.column(2).to_numpy().astype(float)
                    for k in np.unique(langs):
                        at = np.flatnonzero(langs == k)
                        expected, log = expected_pieces(t, own.take(pa.array(at)).to_pylist(), n[at], now[:, k])
                        sums[:, k] += expected
                        logs += log
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(piece, -1), pa.int32()), pa.array(np.append(lang, -1), pa.int32()), pa.array(np.append(sums[piece, lang], logs))], ["piece", "lang", "n"])

        # one row for each language and piece of the fixed vocabulary
        got = words.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        piece, lang, n = (c.to_numpy() for c in got.columns)
        likelihood = float(n[piece < 0].sum())
        if history is not None:
            history.append(likelihood)
        counts = np.zeros_like(probabilities)
        counts[piece[piece >= 0], lang[piece >= 0]] = n[piece >= 0]
        probabilities = maximised(counts, smoothing)
        if before is not None and likelihood - before <= rest * abs(likelihood):
            break
        before = likelihood
    shares = np.array([documents[x] for x in names], float)
    return LanguageModel(names, probabilities, np.log(shares / shares.sum()))


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, most_words: int = 500_000) -> DataFrame:
    """id, lang_pred and score (posterior share of that language) of every row. most_words bounds the memory for scored words, not the words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        t = trie(vocabulary)
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.names)))
        for batch in batches:
            for a, b in row_spans(batch.column(1), SPAN_BYTES):
                part = batch.slice(a, b - a)
                texts = [letter_runs(x) for x in part.column(1).to_pylist()]
                if len(known) > most_words:
                    known, table = {}, table[:0]
                new = list({w for x in texts for w in x if w not in known}) if model.names else []
                if new:
                    for w in new:
                        known[w] = len(known)
                    table = np.concatenate((table, log_words(t, model.probabilities, new)))
                names, scores = [], []
                for x in texts:
                    if not x or not model.names:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    logs = table[np.fromiter((known[w] for w in x), np.int64, len(x))].sum(0) + model.prior
                    best = int(logs.argmax())
                    names.append(model.names[best])
                    scores.append(float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), "lang_pred", "score")
