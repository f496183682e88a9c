"""Operators over whole tables: near duplicates, benchmark passages, chats, mixes, neighbours, the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crestline.llm import ann, chat, components, decontaminate, forest_join, pfair, queries, shingles

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def real(sf_dir):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet') ORDER BY doc_id").fetchall()


def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[bool(a and b and i != j and len(a & b) >= threshold * len(a | b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if near[i][j]:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return [sum(row) for row in near], root


def some_texts(seed, families, copies, words=80):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    out = []
    for _ in range(families):
        base = [draw.choice(vocabulary) for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(copies):
            new = list(base)
            for _ in range(draw.randrange(3)):
                new[draw.randrange(words)] = draw.choice(vocabulary)
            out.append(" ".join(new))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("block_rows", [512, 4])
def test_near_duplicates_lose_no_link(spark, block_rows):
    texts = some_texts(1, 12, 9) + [None, "", "one two", "One, two!", "a b c d", "!!!"]
    want_links, want_class = brute_links(texts)
    docs = docs_of(spark, texts).withColumnRenamed("lang", "key").withColumnRenamed("source", "class_id")
    rows = {r.doc_id: r for r in forest_join.near_duplicates(docs, block_rows=block_rows).collect()}
    assert [rows[i].n_links for i in range(len(texts))] == want_links
    assert [rows[i].class_id for i in range(len(texts))] == want_class


def test_near_duplicates_of_real_texts(spark, sf_dir, real):
    want_links, want_class = brute_links([t for _, t in real])
    rows = {r.doc_id: r for r in queries.op2_minhash_forest_join(spark, sf_dir).collect()}
    assert [rows[i].n_links for i, _ in real] == want_links
    assert [rows[i].class_id for i, _ in real] == [real[c][0] for c in want_class]


def test_near_duplicates_of_odd_tables(spark):
    assert forest_join.near_duplicates(docs_of(spark, [])).count() == 0
    long = "word%d " * 1
    texts = [" ".join(f"w{i}" for i in range(50_000)), " ".join(f"w{i}" for i in range(50_001)), long]
    rows = {r.doc_id: r for r in forest_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert rows[0].class_id == rows[1].class_id == 0 and rows[2].n_links == 0
    twice = docs_of(spark, texts).union(docs_of(spark, texts))
    assert forest_join.near_duplicates(twice).where("doc_id = 2").first().n_links == 1


def test_deduplicate_keeps_one_of_each(spark):
    texts = some_texts(2, 6, 5)
    _, classes = brute_links(texts)
    docs = docs_of(spark, texts)
    kept = [r.doc_id for r in forest_join.deduplicate(docs.union(docs)).collect()]
    assert sorted(kept) == sorted(set(classes))
    assert sorted(r.doc_id for r in forest_join.deduplicate(docs.union(docs), most_marks=0).collect()) == sorted(kept)
    other = docs.where("doc_id = 0").withColumn("text", F.lit("words of another text under the same number"))
    assert forest_join.deduplicate(docs.union(other)).where("doc_id = 0").count() == 2
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    assert forest_join.deduplicate(unnamed).count() == len(set(classes))


def test_prefix_depth_meets_the_recall():
    d = forest_join.prefix_depth(0.8, 14, 6, 0.999)
    assert 1 - (1 - 0.8**d) ** 14 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 14


def test_forest_walk_joins_what_all_pairs_join():
    import pyarrow as pa

    draw = np.random.default_rng(14)
    for _ in range(40):
        n, least = int(draw.integers(1, 40)), 0.6
        seeds = draw.integers(0, 256, (3, 20))
        sketch = seeds[draw.integers(0, 3, n)].copy()
        changed = draw.random((n, 20)) < draw.random() * 0.6
        sketch[changed] = draw.integers(0, 256, int(changed.sum()))
        rest = draw.integers(0, 3, n).astype(np.uint64) << np.uint64(16) | draw.integers(0, 2, n).astype(np.uint64)
        group = np.sort(draw.integers(0, 3, n))
        order = np.lexsort((rest, group))
        sketch, rest = sketch[order].astype(np.uint8), rest[order]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        table = pa.table({"sketch": pa.array([x.tobytes() for x in sketch], pa.binary()), "rest": pa.array(rest.view(np.int64))})
        u, v = forest_join.likely_edges(table, starts, least, 2)
        near = ((sketch[:, None] == sketch[None]).mean(2) >= least) & (group[:, None] == group[None])
        tree = np.zeros((n, n), bool)
        tree[u, v] = tree[v, u] = True
        assert (forest_join.roots_of(tree) == forest_join.roots_of(near & ~np.eye(n, dtype=bool))).all() and len(u) < n
        assert near[u, v].all()


def test_near_copies_without_ids_are_linked(spark):
    def text(i, last):
        return " ".join(f"w{i}x{k}" for k in range(60)) + f" {last}"

    # families of near copies: without any id, with some, and single rows; one text without id twice
    rows = [(None, text(0, "a")), (None, text(0, "b")), (None, text(0, "b")), (7, text(1, "a")), (None, text(1, "b")), (5, text(2, "a")), (5, text(3, "a")), (None, text(4, "a")), (None, "")]
    got = forest_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(None, None, 2, 1), (None, None, 2, 2), (None, None, 2, 2), (7, 7, 1, 1), (None, 7, 1, 1), (5, 5, 0, 1), (5, 5, 0, 1), (None, None, 0, 1), (None, None, 0, 1)]
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == Counter(want)


def test_word_hashes_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["Alpha beta", None, "", "beta  ALPHA gamma", "é É"]
    row, h = shingles.words(pa.array(texts))
    own = [shingles.words(pa.array([t]))[1] for t in texts]
    assert (h == np.concatenate(own)).all() and row.tolist() == [0, 0, 3, 3, 3, 4, 4]
    assert h[0] == h[3] and h[1] == h[2] and h[5] == h[6]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (700, 700)]
    rows = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert rows == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def edited(text, every, draw):
    out = list(text)
    for _ in range(len(text) // every):
        p = draw.randrange(len(out))
        draw.choice([lambda: out.__setitem__(p, "q"), lambda: out.pop(p), lambda: out.insert(p, "q")])()
    return "".join(out)


def test_benchmark_passages_are_found(spark, real, sf_dir):
    draw = random.Random(5)
    bench = duckdb.connect().execute(f"SELECT item_id, text FROM read_parquet('{sf_dir}/benchmark.parquet')").fetchall()
    clean = [re.sub(r"\w+", lambda m: m[0][::-1], t or "") for _, t in real[:60]]
    texts, want = list(clean), []
    for n, (i, t) in enumerate(bench[:30]):
        host = clean[n]
        c = draw.randrange(len(host) + 1)
        texts.append(host[:c] + " " + edited(t.upper() if n % 3 == 0 else t, 25, draw) + " " + host[c:])
        want.append((len(texts) - 1, i))
    texts += [None, "", "x" * 200_000]
    benchmark = spark.createDataFrame([*bench, (900, None), (901, ""), (902, "short")], "item_id bigint, text string")
    docs = docs_of(spark, texts).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "edits")
    for size in (16_000_000, 2_000):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark, block_bytes=size).collect()}
        assert got == set(want)
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts)


def plain_fold(text):
    return re.sub(r"\s+", " ", "".join(c.lower()[0] if c.isalnum() else " " for c in text or "")).strip()


def fewest_edits(segments, text):
    """Least edits of each segment (rows of equal length) to any part of text, by the full table of Sellers."""
    m = segments.shape[1]
    down = np.arange(m + 1)
    column = np.tile(down, (len(segments), 1))
    best = column[:, -1].copy()
    for c in np.frombuffer(text.encode("utf-32-le"), np.uint32):
        new = column + 1
        new[:, 0] = 0
        new[:, 1:] = np.minimum(new[:, 1:], column[:, :-1] + (segments != c))
        column = np.minimum.accumulate(new - down, 1) + down
        np.minimum(best, column[:, -1], out=best)
    return best


def plain_search(docs, items, width=64, per_edit=16, q=12, least=40):
    """What decontamination finds, by all edit tables: doc, item, number of segments, fewest edits."""
    out = set()
    for i, t in items:
        item = plain_fold(t)
        if len(item) < least:
            out |= {(d, i, 1, 0) for d, x in docs if len(item) >= 12 and f" {item} " in f" {plain_fold(x)} "}
            continue
        w = min(width, len(item))
        begins = sorted({*range(0, len(item) - w + 1, w // 8), len(item) - w})
        segments = np.array([[ord(c) for c in item[b : b + w]] for b in begins])
        most = min(w // per_edit, (w - q) // q)
        for d, x in docs:
            edits = fewest_edits(segments, plain_fold(x))
            if (edits <= most).any():
                out.add((d, i, int((edits <= most).sum()), int(edits.min())))
    return out


def test_decontamination_against_all_edit_tables(spark):
    draw = random.Random(21)
    line = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(n))
    items = [(i, line(draw.choice([6, 12, 25, 40]))) for i in range(6)] + [(6, "ab " * 30), (7, line(25)), (8, "short one here")]
    docs = []
    for n in range(60):
        _, t = draw.choice(items)
        a = draw.randrange(max(1, len(t) - 64))
        part = t[a : a + draw.choice([40, 64, 71, 90, 200])]
        docs.append((n, line(draw.randrange(20)) + " " + edited(part, draw.choice([9, 12, 15, 18, 25, 60, 1000]), draw) + " " + line(draw.randrange(20))))
    docs += [(60, "ab " * 60), (61, None), (62, "")]
    want = plain_search(docs, items)
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_segments, r.edits) for r in decontaminate.contaminated(table, benchmark).collect()}
    assert got == want and 20 < len(want) < 62


def test_decontamination_query_against_all_edit_tables(spark, sf_dir, real):
    """Every third item of the benchmark, and those that the query found, over the shorter texts of the table."""
    bench = duckdb.connect().execute(f"SELECT item_id, text FROM read_parquet('{sf_dir}/benchmark.parquet') ORDER BY item_id").fetchall()
    short = [(i, t) for i, t in real if len(t or "") < 700]
    got = {(r.doc_id, r.item_id, r.n_segments, r.edits) for r in queries.op1_qgram_decontamination(spark, sf_dir).collect() if r.doc_id in dict(short)}
    seen = {i for _, i, _, _ in got}
    items = [x for k, x in enumerate(bench) if k % 10 == 0 or x[0] in seen]
    assert got - {x for x in got if x[1] not in dict(items)} == plain_search(short, items)


@pytest.mark.parametrize("n", [30_000])
def test_repetitive_texts_take_bounded_memory(n):
    import tracemalloc

    index = decontaminate.Index([(1, "ab " * 200), (2, "which of the " * 100)], **decontaminate.OPTIONS)
    tracemalloc.start()
    found = decontaminate.search(["ab " * n, "which of the following " * (n // 8)], index)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r, i) for r, i, *_ in found] == [(0, 0)] and most < 500_000_000


def test_short_passages_and_short_items_are_found(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9)))
    long = " ".join(word() for _ in range(60))[:300].strip()
    own = " ".join(word() for _ in range(20)).replace("a", "z")
    items = [(1, long), (2, "Who wrote the Iliad?"), (3, "法国的首都是哪里"), (4, "yes"), (5, "Name the tallest mountain in Asia")]
    texts = [f"{own} {long[c : c + n]} {own}" for n in (71, 80, 95) for c in range(0, len(long) - n + 1, 3)]
    want = {(i, 1) for i in range(len(texts))}
    extra = ["He asked: who  WROTE the Iliad", "who wrote the iliads", "他问法国的首都是哪里,没人知道", "yes, who wrote it", "Name the tallest mountain in Asia!", "name the tallest fountain in asia", "surname the tallest mountain in asia"]
    want |= {(len(texts), 2), (len(texts) + 2, 3), (len(texts) + 4, 5)}
    docs = docs_of(spark, texts + extra)
    for some in (items, items[1:]):
        benchmark = spark.createDataFrame(some, "item_id bigint, text string")
        got = decontaminate.contaminated(docs, benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, i in want if i in dict(some)}
        assert all((texts + extra)[r.doc_id][r.start :].lower().startswith(("who", "法国", "name")) for r in got if r.item_id > 1)
        assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == set(range(len(texts) + len(extra))) - {r.doc_id for r in got}


def test_banded_alignment_against_full_table():
    draw = random.Random(6)
    for _ in range(100):
        m = draw.randrange(4, 12)
        seg = np.array([draw.randrange(3) for _ in range(m)], np.uint32)
        win = np.array([[draw.randrange(3) for _ in range(m + 6)]], np.uint32)
        # the full table over the same seven diagonals
        far = 10**6
        table = [[0 if j < 7 else far for j in range(m + 7)]]
        for i in range(1, m + 1):
            row = [far] * (m + 7)
            for j in range(i, i + 7):
                row[j] = min(table[-1][j] + 1, row[j - 1] + 1 if j > i else far, table[-1][j - 1] + int(seg[i - 1] != win[0, j - 1]))
            table.append(row)
        assert decontaminate.aligned(seg, win, m)[0] == min(table[-1])


def test_lemma_bound_leaves_a_shared_gram():
    ix = decontaminate.Index([(1, "abcdefghij klmnopqrst uvwxyz " * 8)], 12, 96, 16, 40)
    for m in range(40, 97):
        assert m + 1 - ix.q * (ix.budget(m) + 1) >= 1


TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"


def expected_digest(turns):
    order = sorted(turns, key=lambda t: ((t[0] is not None, t[0] or 0), t[1] or "", t[2] or ""))
    whole = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in order)
    loss = "".join(x or "" for _, r, x in order if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(order), sha(whole), len(loss), sha(loss)


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>x<|im_end|>", "\\_<|im_end|", "\\\\", "<\\_s>", "", None, "<", "$1 \\$", "é\n🙂", "[INST][/INST]<<SYS>>"]
    draw = random.Random(7)
    talks = {c: [(t if draw.random() > 0.1 else None, draw.choice(["user", "assistant", "system", None, "a\n<s>"]), draw.choice(nasty)) for t in range(draw.randrange(1, 7))] for c in range(60)}
    talks[60] = [(0, "user", "only")]
    talks[61] = [(0, "assistant", "x"), (0, "assistant", "x"), (1, "user", "y" * 100_000)]
    rows = [(c, *t, "clash") for c, ts in talks.items() for t in ts]
    examples = chat.format_chats(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(examples).collect()}
    assert got == {c: expected_digest(t) for c, t in talks.items()}
    per = Counter(r.conv_id for r in examples.where("loss_start is not null").collect())
    assert all(per[c] == sum(r == "assistant" for _, r, _ in t) for c, t in talks.items())
    for r in examples.where("conv_id = 61").collect():
        assert r.loss_start is None or r.formatted[r.loss_start : r.loss_end] == "x"
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_no_control_string_survives_escaping(spark):
    rows = spark.createDataFrame([(c,) for c in chat.CONTROLS] + [("\\" + c,) for c in chat.CONTROLS], "t string")
    for r in rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def brute_mix(sizes, weights):
    """Slots of (source, block) by earliest deadline in each frame, source names in order."""
    names, out, done = sorted(sizes), {}, Counter()
    start = 0
    while any(done[s] < sizes[s] for s in names):
        m = {s: min(weights[s], sizes[s] - done[s]) for s in names}
        width, placed = sum(m.values()), Counter()
        for t in range(width):
            ready = [(-(-(placed[s] + 1) * width // m[s]), i, s) for i, s in enumerate(names) if placed[s] < m[s] and placed[s] * width // m[s] <= t]
            s = min(ready)[2]
            out[s, done[s] + placed[s]] = start + t
            placed[s] += 1
        done.update(placed)
        start += width
    return out


def test_mix_equals_brute_force(spark):
    draw = random.Random(8)
    sizes = {"a": 40, "b": 7, "c": 13, "d": 1}
    weights = {"a": 5, "b": 2, "c": 3, "d": 4}
    names = [s for s, n in sizes.items() for _ in range(n)]
    draw.shuffle(names)
    docs = docs_of(spark, ["t"] * len(names), lambda i: names[i]).withColumnRenamed("lang", "slot")
    rows = pfair.mix(docs, weights).collect()
    assert {(r.source, r.block): r.slot for r in rows} == brute_mix(sizes, weights)
    assert sorted(r.position for r in rows) == list(range(len(names)))
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_mix_deviates_less_than_a_block(spark):
    weights = {"a": 7, "b": 3, "c": 1, "d": 1}
    docs = docs_of(spark, ["t"] * 1200, lambda i: "abcd"[i % 4])
    rows = sorted(pfair.mix(docs, weights).collect(), key=lambda r: r.position)
    seen = Counter()
    for t, r in enumerate(rows[:400], 1):  # until the first source ends
        seen[r.source] += 1
        assert all(abs(seen[s] - w * t / 12) < 1 for s, w in weights.items())


def test_mix_of_blocks_and_odd_rows(spark):
    docs = docs_of(spark, [None] * 50, lambda i: None if i < 20 else "x")
    docs = docs.union(docs.limit(3))
    rows = pfair.mix(docs, {"x": 2}, block_rows=4).collect()
    assert sorted(r.position for r in rows) == list(range(53))
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.source, r.block].append(r.position)
    assert all(max(p) - min(p) == len(p) - 1 for p in blocks.values())
    assert pfair.mix(docs.limit(0), {"x": 2}).count() == 0
    assert pfair.mix(docs, {"x": 2}, most_entries=0).count() == 53
    with pytest.raises(ValueError):
        pfair.mix(docs, {"x": 0})
    assert pfair.whole_weights({"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 2, "b": 1, "c": 1}


def test_neighbours_reach_the_recall(spark, sf_dir):
    rows = queries.op10_anisotropic_search(spark, sf_dir).collect()
    data = duckdb.connect().execute(f"SELECT vec_id, embedding FROM read_parquet('{sf_dir}/embeddings.parquet') ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(best) & {v for v, _ in got[q]})
        assert all(abs(score - s[ids == v][0]) < 1e-12 for v, score in got[q])
        assert [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
    assert set(got) == set(ids[ids % 20 == 0]) and hits >= 0.9 * 20 * len(got)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 2.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, None, 1.0]), (8, [1.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score double, list int")
    got = ann.search(table, F.col("id") % 2 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0), (2, 3, 3, 0.0)]
    assert ann.search(table.limit(0), F.col("id") % 2 == 0).count() == 0


@pytest.mark.parametrize("spread", [0.15, None])
def test_recall_over_many_lists(spark, spread):
    draw = np.random.default_rng(15)
    x = draw.normal(size=(6000, 24))
    if spread is not None:
        x = draw.normal(size=(40, 24))[draw.integers(0, 40, 6000)] + x * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = ann.search(table, F.col("id") % 20 == 0, list_rows=128, chunk_bytes=10_000, most_held=300).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argpartition(-s, 20)[:20].tolist()) & set(got[q]))
    assert len(got) == 300 and all(len(v) == len(set(v)) == 20 for v in got.values()) and hits >= 0.95 * 20 * 300


def test_queries_unlike_the_other_rows_lose_no_neighbour(spark):
    draw = np.random.default_rng(31)
    x = draw.normal(size=(60, 24))[draw.integers(0, 60, 4000)] * 3 + draw.normal(size=(4000, 24)) * 0.3
    x[::20] = draw.normal(size=(200, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann.search(table, F.col("id") % 20 == 0, list_rows=100).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    for q in range(0, 4000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(4000), -s))[:20].tolist()


def test_equal_vectors_tie_to_the_smaller_id(spark):
    draw = np.random.default_rng(16)
    base = draw.normal(size=(3, 50))
    table = spark.createDataFrame([(i, base[i % 3].tolist()) for i in range(303)], "vec_id bigint, embedding array<double>").repartition(5)
    for r, rows in itertools.groupby(sorted(ann.search(table, F.col("id") < 3, chunk_bytes=4000, list_rows=50).collect(), key=lambda r: (r.query_id, r["rank"])), key=lambda r: r.query_id):
        rows = list(rows)
        assert [(-x.score, x.vec_id) for x in rows] == sorted((-x.score, x.vec_id) for x in rows)
        own = [x.vec_id for x in rows if x.vec_id % 3 == r % 3]
        assert own == list(range(r + 3, r + 3 + 3 * len(own), 3))


def test_queries_in_a_small_list_go_on(spark):
    draw = np.random.default_rng(13)
    x = draw.normal(size=(305, 8)) * 0.05 + np.eye(8)[0] * np.where(np.arange(305) < 300, 1, -50)[:, None]
    assert ann.fit_arrays(x, 2).probes == 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(304, x[304].tolist())] * 30, "vec_id bigint, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(table, F.col("id") % 4 == 0, list_rows=200).collect())
    assert got == {q: 20 for q in range(0, 305, 4)}


def test_a_list_of_most_vectors_is_split(spark):
    assert ann.chunk_counts(np.array([0, 10, 900]), 4, 320).tolist() == [1, 1, 90]
    draw = np.random.default_rng(21)
    x = np.concatenate((np.tile(draw.normal(size=8), (900, 1)), draw.normal(size=(100, 8)) * 3))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = ann.search(table, F.col("id") % 20 == 0, list_rows=50, chunk_bytes=64 * 40).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 1000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1000), -s))[:20].tolist()) & set(got[q]))
    assert all(len(v) == 20 for v in got.values()) and hits >= 0.95 * 20 * 50


def test_samples_of_unlike_lengths_mask_their_own_row():
    draw = np.random.default_rng(22)
    x = draw.normal(size=(500, 6)) * draw.uniform(0.1, 5, (500, 1))
    model = ann.fit_arrays(x, 10, k=5)
    assert 1 <= model.probes <= 10 and 0 < model.share <= 1


def test_large_components_take_part(spark):
    table = spark.createDataFrame([(i, [1e20 * (i + 1), 1e20, -1e20]) for i in range(6)], "vec_id bigint, embedding array<float>")
    got = ann.search(table, F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 4, 3, 2, 1]


def test_clustered_vectors_visit_few_lists():
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(32, 16)) * 5
    x = centres[draw.integers(0, 32, 4000)] + draw.normal(size=(4000, 16)) * 0.1
    assert ann.fit_arrays(x, 32).probes <= 8


def test_anisotropic_codes_lower_the_parallel_error():
    draw = np.random.default_rng(10)
    x = draw.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rest, direction = ann.paired(x), ann.paired(x)
    books = np.stack([rest[draw.choice(2000, 16, False), m] for m in range(8)])

    def parallel(weight):
        codes = ann.encode(rest, direction, books, weight)
        return (((rest - books[np.arange(8), codes]) * direction).sum((1, 2)) ** 2).mean()

    assert parallel(3.0) < parallel(0.0)


def test_table_scan_equals_decoded_products():
    draw = np.random.default_rng(11)
    books, codes, q = draw.normal(size=(5, 16, 2)), draw.integers(0, 16, (30, 5)), draw.normal(size=(4, 10))
    decoded = books[np.arange(5), codes].reshape(30, 10)
    assert np.allclose(ann.scan(ann.query_tables(q, books), ann.packed(codes).astype(np.intp)), q @ decoded.T, atol=1e-5)


def test_pipeline(spark, sf_dir, real, tmp_path):
    c = corpus_pipeline
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in c.STAGES:
        stage(spark, kept[-1], sf_dir).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    good = {r.doc_id for r in queries.op4_pairwise_quality(spark, sf_dir).where("predicted = 1").collect()}
    assert ids[1] == good
    left = [(i, t) for i, t in real if i in good]
    _, classes = brute_links([t for _, t in left])
    assert ids[2] == {left[k][0] for k in set(classes)}
    found = {r.doc_id for r in queries.op1_qgram_decontamination(spark, sf_dir).collect()}
    assert ids[3] == ids[2] - found and ids[4] == ids[3] == ids[5]
    assert all(k.columns == columns for k in kept[1:5]) and set(columns) < set(kept[5].columns)
    assert sorted(r.position for r in kept[5].collect()) == list(range(len(ids[5])))
    assert {tuple(r) for r in c.run(spark, sf_dir).select("doc_id", "text", "position").collect()} == {tuple(r) for r in kept[5].select("doc_id", "text", "position").collect()}


def test_pipeline_of_an_empty_table(spark, sf_dir):
    c = corpus_pipeline
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


CLASHES = ["_source", "_cell", "_n", "_before", "_in", "_place", "_frames", "_f", "_frame", "_slot", "_base", "_lacks", "_held", "_given", "_by", "_hash", "_row", "_text", "_lost", "_again", "_y", "x", "key", "score", "_score", "kinds", "_kinds", "extra"]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    kept = dict(corpus_pipeline.STAGES)[stage](spark, wide, sf_dir)
    assert kept.columns[: len(wide.columns)] == wide.columns
    rows = kept.select("doc_id", *[F.col(c).alias(f"c{i}") for i, c in enumerate(CLASHES)]).collect()
    assert rows and all(list(r[1:]) == [f"{c} {r.doc_id}" for c in CLASHES] for r in rows)


def test_rows_of_one_id_have_one_place_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}", "src0") for i in range(30)], "doc_id bigint, text string, source string")
    places = [{r.text: r.position for r in pfair.mix(d, {}).collect()} for d in (docs, docs.repartition(5), docs.orderBy(F.desc("text")))]
    assert places[0] == places[1] == places[2] and sorted(places[0].values()) == list(range(30))
