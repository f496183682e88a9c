"""Operators on sources, periodic runs and language models."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import divergence, hmm, oracles, queries, runs

DOCS = "doc_id bigint, text string, lang string, source string, rank int, value string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, 0, "v") for i, r in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def real(sf_dir):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall()


# --- sources that differ


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [[i, *r] for i, r in enumerate(rows)])
    return sorted(tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({oracles.DIVERGENCE})").fetchall())


def by_spark(docs, **more):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs, **more).collect())


def test_divergence_equals_sql_on_odd_rows(spark):
    rnd = random.Random(5)
    words = ["Ab", "b", "ÀÉ", "漢字", "éa", "zz", "the", "ab", "cD-ef", "x1y", "a" * 40 + "b", "a" * 40 + "c"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(0, 30))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "S", None, "ü"])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "fr", "one"), ("w " * 60_000, "en", "s1"), ("only here", "xx", "a"), ("nor here", "xx", "b")]
    rows += [("twice the same", "en", "s2")] * 12
    assert by_spark(docs_of(spark, rows)) == by_sql(rows)
    assert by_spark(docs_of(spark, [])) == []
    assert by_spark(docs_of(spark, [(None, None, None)])) == []


def test_sources_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "MOST_BROADCAST", 0)
    rnd = random.Random(6)
    rows = [(" ".join(rnd.choices("abcdefgh", k=6)), "en", f"s{rnd.randrange(11)}") for _ in range(120)]
    assert by_spark(docs_of(spark, rows)) == by_sql(rows)


def test_leading_rows_of_a_group(spark):
    rnd = random.Random(7)
    rows = [(g, "".join(rnd.choices("ab", k=rnd.randrange(1, 9))) + rnd.choice(["", "é", "z" * 50]), rnd.choice([0, 1, 5, 1 << 40])) for g in "wxyz" for _ in range(300 if g != "z" else 4)]
    rows = list({(g, t): (g, t, v) for g, t, v in rows}.values())
    got = divergence.leading(spark.createDataFrame(rows, "g string, t string, v bigint"), ["g"], "v", "t", 7).collect()
    want = [(g, t, v, i) for g in "wxyz" for i, (_, t, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:7], 1)]
    assert sorted((r.g, r.t, r.v, r["rank"]) for r in got) == sorted(want)


# --- periodic runs


def plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - start
            own = words[start : start + size]
            if size >= max(6, 4 * q) and not any(all(own[k] == own[k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((start, size, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rnd, n, kinds):
    words = [rnd.randrange(kinds) for _ in range(n)]
    if rnd.random() < 0.6 and n > 10:
        root = words[: rnd.randrange(1, 6)]
        words = words[: rnd.randrange(n)] + (root * rnd.randrange(3, 9))[: -rnd.randrange(1, 3)] + words[rnd.randrange(n) :]
    return words


def test_runs_equal_plain_search():
    rnd = random.Random(1)
    texts = [some_words(rnd, rnd.randrange(0, 60), rnd.choice([1, 2, 3, 8])) for _ in range(1500)]
    want = [plain_runs(t) for t in texts]
    assert [runs.stretch_runs(t) for t in texts] == want
    assert runs.texts_runs([[str(w).encode() for w in t] for t in texts]) == want
    assert sum(map(len, want)) > 500


def test_runs_where_hashes_err(monkeypatch):
    monkeypatch.setattr(runs, "PRIME", 7)
    monkeypatch.setattr(runs, "BASE", 3)
    monkeypatch.setattr(runs, "NEAR", 2)
    rnd = random.Random(2)
    for _ in range(500):
        words = some_words(rnd, rnd.randrange(0, 60), rnd.choice([1, 2, 3]))
        assert runs.stretch_runs(words) == plain_runs(words)


def test_long_runs_take_few_steps():
    assert runs.stretch_runs([0] * 50_000) == [(0, 50_000, 1)]
    assert runs.stretch_runs(list(range(500)) * 100) == [(0, 50_000, 500)]


def expected_run_row(key, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in found), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    return (len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def run_rows(found):
    return {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in found.collect()}


def test_run_query_equals_plain_search(spark, sf_dir, real):
    assert run_rows(queries.op12_lyndon_runs(spark, sf_dir)) == {i: expected_run_row(i, t) for i, t in real}


def test_runs_of_odd_texts(spark):
    texts = [None, "", " \t\n", "a", "a " * 6, "a " * 5, "é ü " * 4, "x\x1cy " * 7, "a\x0bb\x0ca\rb " * 5, "la " * 30_000, "  " * 8, "a b c " * 4 + "a b d " * 4]
    docs = docs_of(spark, [(t, "en", "s") for t in [*texts, *texts]])
    got = run_rows(runs.digest(runs.periodic_runs(runs.plant(docs))))
    assert got == {i: expected_run_row(i, t) for i, t in enumerate([*texts, *texts]) if t is None or len(t) < 10_000} | {i: got[i] for i in got if len([*texts, *texts][i] or "") >= 10_000}
    assert {got[i][:4] for i in got if len([*texts, *texts][i] or "") >= 10_000} == {(1, 0, 30_000, 1)}
    assert runs.periodic_runs(docs_of(spark, [])).count() == 0
    one = runs.periodic_runs(docs_of(spark, [("go on " * 5 + "end", "en", "s")])).first()
    assert one.collapsed == "go on end" and [tuple(r) for r in one.runs] == [(0, 10, 2)]
    spare = spark.createDataFrame([(None, "b b b b b b")], "doc_id bigint, text string")
    assert [tuple(r) for r in runs.periodic_runs(runs.plant(spare)).first().runs] == [(0, 6, 1)]


# --- language model


def small_model(random, states, buckets):
    part = lambda shape, axis: (x := random.random(shape)) / x.sum(axis, keepdims=True)
    return hmm.Model(part(states, 0), part((states, states), 1), part((buckets, states), 0), np.arange(buckets), np.ones(buckets, int))


def test_passes_equal_sums_over_all_paths():
    random = np.random.default_rng(0)
    model = small_model(random, 3, 7)
    sizes = np.array([3, 1, 5, 2, 4, 1])
    codes = random.integers(0, 7, sizes.sum())
    logs, start, step, emit = [], np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for text in np.split(codes, np.cumsum(sizes)[:-1]):
        paths = {}
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.step[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        logs.append(math.log10(total))
        for path, p in paths.items():
            start[path[0]] += p / total
            for t, k in enumerate(path):
                emit[text[t], k] += p / total
                if t:
                    step[path[t - 1], k] += p / total
    for most in (1, 3, 6, 100):
        assert np.allclose(hmm.log_likelihoods(model, codes, sizes, most), logs)
        got = hmm.expected_counts(model, codes, sizes, most)
        assert np.allclose(got.start, start) and np.allclose(got.step, step) and np.allclose(got.emit, emit) and np.isclose(got.log, sum(logs))


def test_numbers_packed():
    values = np.random.default_rng(1).integers(0, 1 << 32, 1000)
    assert (hmm.unpack(hmm.pack(values)) == values).all() and len(hmm.unpack(hmm.pack(values[:0]))) == 0


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), ""]


def base_rows(rows, learned):
    counts = Counter(w for i, t in rows if learned(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(own := tokens_of(t)), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for i, t in rows}


def test_scores_of_the_query(spark, sf_dir, real):
    rows = {r.doc_id: r for r in queries.op13_hidden_markov_scores(spark, sf_dir).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in real}
    want = base_rows(real, lambda i: not held[i])
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in rows.items()} == {i: w[:3] for i, w in want.items()}
    assert all(math.isclose(r.base_score, want[i][3], rel_tol=1e-9) and r.held_out == held[i] for i, r in rows.items())
    # held-out texts are likelier under the states than under words alone
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)
    assert all(r.score < 0 for r in rows.values())


def test_learning_raises_the_likelihood(spark, real):
    docs = docs_of(spark, [(t, "en", "s") for _, t in real])
    history = []
    hmm.score_texts(docs, F.lit(True), states=3, rounds=4, rest=0, history=history).count()
    assert len(history) == 4 and history == sorted(history)
    # the same whatever the partitions
    again = []
    hmm.score_texts(docs.repartition(5), F.lit(True), states=3, rounds=2, rest=0, history=again).count()
    assert np.allclose(history[:2], again)


def test_scores_sum_to_one_over_words(spark):
    """All texts of one word, and one stand-in for all unknown words of each bucket, share the probability of an emission."""
    docs = docs_of(spark, [("a b a", "en", "s"), ("c a", "en", "s")])
    table = hmm.blocks(docs, F.lit(True)).cache()
    counts = hmm.word_counts(hmm.block_words(table))
    model = hmm.fit(table, counts, states=2, rounds=2)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.step.sum(1), 1) and math.isclose(model.start.sum(), 1)
    per = defaultdict(int)
    for r in counts.collect():
        per[zlib.crc32(r.word.encode()) % (hmm.BUCKETS - 1) + 1 if r.word else 0] += r.n + 1
    assert all(model.count[b] + model.kinds[b] == n for b, n in per.items()) and model.tokens == 7 and model.words == 4
    table.unpersist()


def test_scores_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 100)
    texts = [None, "", " \n", "A a Á", "w " * 5000, "x" * 100_000, "new words", "a\x0bb\x1cc", "a a", "a a"]
    docs = docs_of(spark, [(t, "en", "s") for t in texts])
    rows = {r.doc_id: r for r in hmm.score_texts(docs, F.col("doc_id") != 6, rounds=2).collect()}
    want = base_rows(list(enumerate(texts)), lambda i: i != 6)
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in rows.items()} == {i: w[:3] for i, w in want.items()}
    assert all(math.isclose(r.base_score, want[i][3], rel_tol=1e-9) and math.isfinite(r.score) for i, r in rows.items())
    assert math.isclose(rows[8].score, rows[9].score, rel_tol=1e-9)
    none = hmm.score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and r.base_score == 0 for r in none)
    assert hmm.score_texts(docs_of(spark, []), F.lit(True)).count() == 0
