"""Each operator against brute force, an exact round trip or the accuracy it must have."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import textwrap
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, hmm, html_text, licenses, mixing, near_dedup, packing, quality, registry, sharding, toxicity

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "na pe ri so tu va xe zi".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Prose, exact copies, near copies of one text in number, repeated lines, junk, short and empty ones."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 200).split()
    for _ in range(25):
        changed = list(base)
        changed[rng.randrange(len(changed))] = "changed"
        out.append(" ".join(changed))
    out += [out[0].upper(), out[1], out[1], "", None, "a b c", "A B  c", "x\nx\nx y z\nx", "## $$ %% && ** ## $$ %% && ** word word"]
    out += [out[2] + " " + out[3], " ".join(base[:150]), " ".join(base[:180]), "a text that ends <|endoftext|> and goes on <|endoftext|>"]
    mit = licenses.KNOWN[1][1]
    out += [mit, "Before it.\n\n  Copyright (c) 1999 A. N. Other\n" + mit.replace(", ", ",\n  * ") + "\nAfter it.\nLicensed under CC BY-NC 4.0."]
    return out


@pytest.fixture(scope="module")
def corpus(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(path / "documents.parquet"))
    items = [(1, " ".join(texts[0].split()[:14])), (2, texts[3].upper()), (3, texts[3]), (4, "## $$ a"), (5, ""), (6, None), (None, "changed"), (7, "nowhere to be found in any of the texts at all here")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(path / "benchmark.parquet"))
    rng = random.Random(8)
    vectors = [[rng.choice([-1.0, 0.0, 1.0]) * (i % 7) + rng.random() for _ in range(64)] for i in range(150)]
    vectors += [vectors[3], vectors[3], [0.1] * 63, None, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [float("-inf")] + [0.1] * 63, [300.5] * 64]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(3).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(name, spark, corpus):
    con = duckdb.connect()
    for name_of in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM read_parquet('{corpus}/{name_of}.parquet/*.parquet')")
    wanted = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    got = registry.queries()[name](spark, corpus)
    assert sorted(got.columns) == sorted(columns)
    show = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(show, got.select(*columns).collect())) == sorted(map(show, wanted.fetchall()))


# --- toxicity


def test_maximal_segments_against_definition():
    rng = random.Random(1)
    for _ in range(200):
        evidence = [(i, rng.choice([0.5, 1.0, 2.0])) for i in range(30) if rng.random() < 0.3]
        drift = 0.4
        scores = [-drift] * 30
        for i, s in evidence:
            scores[i] = s

        def best(a, b):
            """The best segment of a stretch, then the same to its left and right."""
            found = max(((sum(scores[i : j + 1]), -i, j) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0), key=lambda x: (round(x[0], 9), -(x[2] + x[1]), x[1]))
            if found[0] <= 1e-9:
                return []
            i, j = -found[1], found[2]
            return [*best(a, i), (round(found[0], 6), i, j), *best(j + 1, b)]

        assert [(round(s, 6), i, j) for s, i, j in toxicity.maximal_segments(evidence, drift)] == best(0, 30)


def test_toxicity_held_out(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 200)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "grott" + rng.choice(WORDS), "grott" + rng.choice(WORDS)]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    toxic = [r for r in held if r.doc_id % 6 == 0]
    clean = [r for r in held if r.doc_id % 6]
    assert sum(r.predicted for r in toxic) >= 0.95 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    text = dict(docs)
    assert all("vile" in text[r.doc_id][p.start : p.end] or "grott" in text[r.doc_id][p.start : p.end] for r in toxic for p in r.passages)


def test_toxicity_rare_words_in_many_rows(spark, tmp_path):
    """A word of three toxic training rows and no clean one counts, however many other words the training rows hold."""
    rng = random.Random(8)
    common = [a + b + c for a in WORDS[:20] for b in WORDS[20:40] for c in WORDS[40:60]]
    rare = ["x" + a + b + "vile" for a in "qwz" for b in "bcdfghjk"]
    docs, labels, seen = [], [], dict.fromkeys(rare, 0)
    for i in range(3000):
        words = rng.sample(common, 500)
        if i % 10 == 0:
            held_out = zlib.crc32(str(i).encode()) % 3 == 1
            left = [w for w in rare if held_out or seen[w] < 3]
            for w in left[:4]:
                words.insert(250, w)
                seen[w] += not held_out
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 10 == 0)))
    assert set(seen.values()) == {3}
    spark.createDataFrame(docs, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [r for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect() if r.held_out and r.doc_id % 10 == 0]
    text = dict(docs)
    assert rows and all(any("vile" in text[r.doc_id][p.start : p.end] for p in r.passages) for r in rows)


# --- quality


def test_repeat_words_by_hand(make_docs):
    texts = ["a b c d e a b c d e", "a b c d e f g", "x x x x x x x", "p q r s t u p q r s t v", "one"]
    docs = make_docs(list(enumerate(texts)))
    got = {r.doc_id: r.n_repeat_words for r in quality.text_features(docs.select("doc_id", "text"), F.col("text")).collect()}
    assert [got[i] for i in range(5)] == [10, 0, 7, 10, 0]


def test_thresholds_adapt(spark):
    """Each source is held to what is usual in it: many symbols are normal in one and not in the other."""
    rng = random.Random(2)
    rows = [(i, " ".join([rng.choice(WORDS) + ("#" if i % 2 and rng.random() < 0.3 else "") for _ in range(100)]), "en", "code" if i % 2 else "news", 0) for i in range(600)]
    rows += [(1000, " ".join(rng.choice(WORDS) + ("#" if rng.random() < 0.3 else "") for _ in range(100)), "en", "news", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert 1000 not in kept and len(kept) == 600


def test_each_threshold_follows_its_own_group(spark):
    """One and the same document is kept in a source where its like is usual and rejected where it is not, by each metric in turn."""
    rng = random.Random(4)
    plain = lambda n: [rng.choice(WORDS) for _ in range(n)]
    lined = lambda words, repeated: "\n".join([" ".join(words[k : k + 10]) for k in range(0, len(words), 10)] + ["again and again"] * repeated)

    def odd(metric):
        words = plain(200)
        if metric == "symbols":
            words = [w + "#" if k % 8 == 0 else w for k, w in enumerate(words)]
        elif metric == "repeats":
            words[60:80] = words[100:120]
        elif metric == "length":
            words = [w * 3 for w in words]
        return lined(words, 9 if metric == "lines" else 0)

    rows = []
    for metric in ("symbols", "repeats", "lines", "length"):
        for usual in (True, False):
            for k in range(250):
                rows.append((len(rows), odd(metric) if usual and k % 2 else lined(plain(200), 0), "en", f"{metric} {usual}", 0))
            rows.append((len(rows), odd(metric), "en", f"{metric} {usual}", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.source for r in quality.keep_good(docs).filter("n_chars = 1").collect()}
    assert kept == {f"{metric} True" for metric in ("symbols", "repeats", "lines", "length")}


# --- exact dedup


def test_digest_index_over_batches(make_docs, tmp_path):
    docs = make_docs([(1, "one"), (2, "ONE"), (3, "two")])
    index = exact_dedup.DigestIndex(docs.sparkSession, f"index_{tmp_path.name}".replace("-", "_"), str(tmp_path / "index"), 4)
    first = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs, index).collect()}
    assert first == {1: (2, False), 2: (2, True), 3: (3, True)}
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(make_docs([(9, "Two"), (10, "two"), (8, "three"), (0, "one")]), index).collect()}
    assert again == {9: (10, 3, False), 10: (10, 3, True), 8: (8, 1, True), 0: (2, 3, False)}
    third = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(make_docs([(5, "TWO"), (None, "three"), (11, "four")]), index).collect()}
    assert third == {5: (10, 4, False), None: (8, 2, False), 11: (11, 1, True)}
    assert {r.group_size for r in index.read().collect()} == {1, 2, 3, 4} and index.read().count() == 4
    plan = make_docs([(1, "x")]).select(exact_dedup.digest(F.col("text")).alias("text_sha256")).join(index.read().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_batch_added_again_counts_once(make_docs, tmp_path, spark):
    index = exact_dedup.DigestIndex(spark, "index_again", f"file://{tmp_path}/index", buckets=2)
    try:
        first, second = make_docs([(1, "a b"), (2, "a b"), (3, "c")]), make_docs([(9, "A B"), (4, "d")])
        seen = lambda docs, name: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, index, name).collect())
        once = seen(first, "one")
        assert once == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)] == seen(first, "one")
        after = seen(second, "two")
        assert after == [(4, 4, 1, True), (9, 9, 3, True)] == seen(second, "two")
        assert sorted((r.keep_id, r.group_size) for r in index.read().collect()) == [(3, 1), (4, 1), (9, 3)]
    finally:
        index.drop()


def test_batches_give_what_one_gives(make_docs):
    docs = make_docs([(i if i % 9 else None, f"Text {i % 7}" if i % 3 else f"TEXT {i % 7}") for i in range(60)])
    rows = lambda n: sorted(map(str, exact_dedup.exact_duplicates(docs, batches=n).collect()))
    assert rows(1) == rows(2) == rows(5)


def test_an_index_of_its_own_leaves_nothing_behind(make_docs, spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.exact_duplicates(make_docs([(1, "one"), (2, "ONE")])).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before


def test_keep_first_copies(make_docs):
    docs = make_docs([(1, "A"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, "")])
    assert sorted(r.doc_id for r in exact_dedup.keep_first_copies(docs).collect()) == [2, 3, 5]


# --- hidden Markov model


def tiny_model(rng):
    draw = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.1)
    return hmm.Hmm(draw(3), draw(3, 3), draw(3, 5))


def test_forward_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(0)
    model = tiny_model(rng)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (4, 1, 3, 4)]
    start, moves, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for x, got in zip(sequences, model.log_likelihoods(sequences)):
        paths = {}
        for path in itertools.product(range(3), repeat=len(x)):
            p = model.start[path[0]] * model.emit[path[0], x[0]]
            for t in range(1, len(x)):
                p *= model.step[path[t - 1], path[t]] * model.emit[path[t], x[t]]
            paths[path] = p
        likelihood = sum(paths.values())
        assert got == pytest.approx(math.log10(likelihood), abs=1e-12)
        total += math.log(likelihood)
        for path, p in paths.items():
            start[path[0]] += p / likelihood
            for t, state in enumerate(path):
                emit[state, x[t]] += p / likelihood
                if t:
                    moves[path[t - 1], state] += p / likelihood
    got = model.expected(sequences)
    for a, b in zip(got, (start, moves, emit, total)):
        assert np.allclose(a, b)


def test_training_raises_likelihood(spark):
    rng = np.random.default_rng(1)
    x = [(rng.integers(0, 4, 30) + 4 * (i % 2)).astype(np.uint16) for i in range(40)]
    texts = spark.createDataFrame([(s.tobytes(),) for s in x], "classes binary").repartition(3)
    counts = np.bincount(np.concatenate(x), minlength=8).astype(float)
    logs = [hmm.baum_welch(texts, counts, states=2, rounds=n).log_likelihoods(x).sum() for n in (0, 1, 3, 6)]
    assert logs == sorted(logs) and logs[-1] > logs[0] + 1


def test_hmm_scores(spark, corpus, texts):
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + [" "] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    c = Counter(w for t, use in zip(tokens, train) if use for w in t)
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in hmm.op4_hmm_score(spark, corpus).collect()}
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert r.score < 0


def test_hmm_query_by_plain_recursions(spark, corpus, texts):
    """The whole query's score: Baum-Welch and the forward recursion step by step, with logs instead of scales, and shares of classes by counting."""
    tokens = [[*(t or "").encode().lower().split(), hmm.END] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    c = Counter(w for t, use in zip(tokens, train) if use for w in t)
    of = lambda w: zlib.crc32(w) % hmm.CLASSES
    counts, kinds = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in c.items():
        counts[of(w)] += n
        kinds[of(w)] += 1
    model = hmm.Hmm.initial(counts)
    start, step, emit = model.start, model.step, model.emit

    def forward(x):
        """Log-likelihood, and the state probabilities of a prefix with its likelihood's log."""
        rows, logs, now = [], [], start * emit[:, x[0]]
        for t in range(len(x)):
            if t:
                now = (rows[-1] @ step) * emit[:, x[t]]
            logs.append((logs[-1] if logs else 0.0) + math.log(now.sum()))
            rows.append(now / now.sum())
        return rows, logs

    for _ in range(hmm.ROUNDS):
        s, m, e = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES))
        for words, use in zip(tokens, train):
            if not use:
                continue
            x = [of(w) for w in words]
            rows, _ = forward(x)
            after = [np.ones(hmm.STATES)]
            for t in range(len(x) - 1, 0, -1):
                b = step @ (emit[:, x[t]] * after[0])
                after.insert(0, b / b.sum())
            for t in range(len(x)):
                g = rows[t] * after[t]
                e[:, x[t]] += g / g.sum()
                if t == 0:
                    s += g / g.sum()
                else:
                    both = rows[t - 1][:, None] * step * (emit[:, x[t]] * after[t])[None, :]
                    m += both / both.sum()
        prior = (counts + 0.1) / (counts + 0.1).sum()
        e = e + 20.0 * prior
        start, step, emit = (s + 1) / (s + 1).sum(), (m + 1) / (m + 1).sum(axis=1, keepdims=True), e / e.sum(axis=1, keepdims=True)
    got = {r.doc_id: r.score for r in hmm.op4_hmm_score(spark, corpus).collect()}
    for i, words in enumerate(tokens):
        shares = sum(math.log10((c[w] + 0.1) / (counts[of(w)] + 0.1 * (kinds[of(w)] + 1))) for w in words)
        assert got[i] == pytest.approx(forward([of(w) for w in words])[1][-1] / math.log(10) + shares, rel=1e-6)


def test_token_entries_split_large_counts():
    codes = np.zeros(70_000, dtype=np.int32)
    which, entries = hmm.entries_of(codes, np.zeros(70_000, dtype=np.int64), 1)
    assert entries["times"].sum() == 70_000 and len(entries) == 2 and set(which) == {0}


# --- licences


def test_license_variants(make_docs):
    mit = licenses.KNOWN[0][1]
    other = ("Copyright (c) 2020 Somebody\n\n" + mit.replace("sublicense", "sub-license")).replace(". ", ".\n").upper()
    docs = make_docs([(1, mit), (2, other), (3, mit + " and more"), (6, "Words.\n" + other + "\n\nMore words."), (4, "Intro.\nReleased under the MIT Licence!\nEnd."), (5, "Licensed under the Apache License, version 2.0")])
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("MIT", "MIT"), 3: (None, ""), 4: (None, "MIT"), 5: ("Apache-2.0", "Apache-2.0"), 6: (None, "MIT")}


def test_notices_need_no_word_for_licences(make_docs):
    bsd = dict(licenses.KNOWN)["BSD-3-Clause"]
    wrapped = textwrap.fill(bsd, 60)
    got = {r.doc_id: r.notices for r in licenses.scan(make_docs([(1, f"x = 1\n{wrapped}\ny = 2"), (2, wrapped.replace("endorse", "promote"))])).collect()}
    assert got == {1: "BSD-3-Clause", 2: ""}


def test_long_licences_by_their_digests(make_docs):
    folder = Path("/usr/share/common-licenses")
    if not folder.exists():
        pytest.skip("no licence texts on this machine")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {i: (folder / f).read_text() for f, i in names.items()}
    rows = [(k, t) for k, t in enumerate(texts.values())] + [(10 + k, "Notice follows.\n" + t.upper().replace("\n", " \n> ") + "\nThat was it.") for k, t in enumerate(texts.values())]
    got = {r.doc_id: (r.license, r.notices.split(",")) for r in licenses.scan(make_docs(rows)).collect()}
    for k, name in enumerate(texts):
        assert got[k][0] == name and name in got[k][1] and got[10 + k][0] is None and name in got[10 + k][1]


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(licenses, "GROUP", 4)
    rows = [list(range(n)) for n in (0, 1, 4, 5, 8, 21)]
    got = spark.createDataFrame([(r,) for r in rows], "xs array<int>").select("xs", licenses._running_sums(F.col("xs")).alias("sums")).collect()
    assert all(r.sums == list(itertools.accumulate(r.xs)) for r in got) and len(got) == 6


# --- near duplicates


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset())
    links, parent = defaultdict(set), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
            links[i].add(j)
            links[j].add(i)
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return links, root


@pytest.mark.parametrize("tile", [128, 7])
def test_near_duplicates_brute_force(spark, corpus, texts, tile, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    links, root = brute_links(texts)
    rows = near_dedup.op6_near_dedup(spark, corpus).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (root(i), len(links[i])) for i in range(len(texts))}
    assert Counter(r.class_id for r in rows if r.kept) == Counter({root(i): 1 for i in range(len(texts))})
    assert all(r.class_size == sum(root(i) == r.class_id for i in range(len(texts))) for r in rows)


def test_forest_recall_is_what_is_asked_for():
    assert near_dedup.prefix_depth(0.8, 24, 8, 0.9999) == 5
    assert near_dedup.prefix_depth(0.8, 24, 8, 0.98) == 8
    rng = np.random.default_rng(0)
    forest, hits = near_dedup.Forest(24, 5), 0
    for _ in range(300):
        shared, a, b = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
        labels = forest.labels(np.concatenate([shared, a, shared, b]), np.array([180, 180])).reshape(2, 24, 5)
        hits += bool((labels[0] == labels[1]).all(axis=1).any())
    assert hits >= 298


def near_corpus(changes, n=150):
    """Pairs of texts of 100 words, of which each second one has that many words changed, far apart from each other."""
    rng = random.Random(12)
    out = []
    for i in range(n):
        words = [f"w{i}_{k}" for k in range(100)]
        other = list(words)
        for k in range(rng.choice(changes)):
            other[(k * 31 + 7) % 100] = f"x{i}_{k}"
        out += [" ".join(words), " ".join(other)]
    return out


@pytest.mark.parametrize("changes, recall, wanted", [([0, 1], 0.95, 8), ([1, 2], 0.9999, 5), ([2], 0.97, 8)])
def test_prefixes_are_shortened_until_the_recall_is_met(spark, changes, recall, wanted):
    """Very like texts are found at full depth; less like ones need shorter prefixes; the recall is what was asked for."""
    texts, forest = near_corpus(changes), near_dedup.Forest(24, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.select(F.col("doc_id").cast("string").alias("key"), "doc_id", "text")
    rows = near_dedup.labelled(keyed, forest)
    sets = rows.groupBy("set").agg(F.max("key").alias("key"), F.first("labels").alias("labels"))
    tries = near_dedup.sorted_tries(sets.select("set", "labels"), forest, near_dedup.prefix_depth(0.8, 24, 8, recall)).cache()
    shingles = near_dedup.shingle_sets(sets.join(keyed, "key").select("set", F.lit(1).cast("long").alias("copies"), "text")).cache()
    verified, level = near_dedup.search(tries, shingles, near_dedup.SIMILARITY, forest, recall)
    links, _ = brute_links(texts)
    distinct = {frozenset((i, j)) for i in links for j in links[i] if texts[i] != texts[j]}
    assert level == wanted and verified.agg(F.sum("links")).first()[0] >= 2 * recall * len(distinct) > 0


def test_tries_by_brute_force(spark):
    """What a sorted list says of a label's company is what all pairs say, but for the ends of partitions, which count as deep."""
    rng, forest = random.Random(3), near_dedup.Forest(3, 4)
    rows = [(f"{i}".encode(), np.array([rng.randint(0, 2) for _ in range(12)], dtype=">u2").tobytes()) for i in range(300)]
    got = {(r.tree, bytes(r.set)): r.depth for r in near_dedup.sorted_tries(spark.createDataFrame(rows, "set binary, labels binary").repartition(3), forest, 0).collect()}
    ends = 0
    for tree in range(3):
        labels = {name: label[8 * tree : 8 * tree + 8] for name, label in rows}
        for name, label in labels.items():
            deepest = max(next((k for k in range(4) if label[2 * k : 2 * k + 2] != other[2 * k : 2 * k + 2]), 4) for n, other in labels.items() if n != name)
            assert got[tree, name] in (deepest, 4)
            ends += got[tree, name] != deepest
    assert len(got) == 900 and ends <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_chain_is_not_one_block(spark):
    """Texts that hang together only by a chain of likenesses stay in many blocks."""
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(words[8 * i : 8 * i + 120]) for i in range(200)]
    forest = near_dedup.Forest(24, 8)
    keyed = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "key string, doc_id long, text string")
    tries = near_dedup.sorted_tries(near_dedup.labelled(keyed, forest).select("set", "labels"), forest, 5)
    under = tries.select("set", F.xxhash64("tree", F.substring("label", 1, 10)).alias("node")).cache()
    blocks = near_dedup.gathered(under).groupBy("block").count().collect()
    assert len(blocks) > 5 and max(r["count"] for r in blocks) < 100
    links, root = brute_links(texts)
    got = near_dedup.near_duplicates(keyed).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (root(i), len(links[i])) for i in range(200)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(150)] + [("5000", f"{i}") for i in range(5001, 5100)] + [("7", "7")]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"{i:04d}"] == "0000" for i in range(151)) and all(got[f"{i}"] == "5000" for i in range(5000, 5100)) and len(got) == 251


# --- packing


def test_hilbert_curve_visits_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)), dtype=np.uint64)
    keys = packing.hilbert(grid, bits=3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_round_trip(spark, corpus, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = packing.pack(docs, length=64, with_ids=True).collect()
    found = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length and r.doc_tokens == len(ids[r.doc_id])
        found[r.doc_id].append((r.start, list(r.ids)))
    assert {d: [x for _, p in sorted(ps) for x in p] for d, ps in found.items()} == dict(enumerate(ids))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    last = max(sequences)
    for s, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or s == last
    order = sorted((r.sequence_id, r.offset, r.curve_key) for r in rows)
    assert [k for _, _, k in order] == sorted(k for _, _, k in order)


def test_ids_are_those_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = packing.encoder("byte_bpe_50k"), random.Random(4)
    pool = [chr(c) for c in [*range(0x180), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    pool += [" ", " ", "\n", "\u3000", "\u200b", "\U0001f600", "\u0301", "\u4e2d", "'ll", "<|endoftext|>", " <|endoftext|>", "<|endoftext|> ", "  ", "\r\n", "ab", ".", ",", " .", "a.", ").", "\xb2"] * 8
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(8000)] + ["x" * 5000, "<|endoftext|>"]
    assert [x.tolist() for x in encode(texts)] == [full.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(["<|endoftext|>"])[0].tolist() == [50256]


def test_ranges_hold_like_numbers_of_tokens(spark):
    """Long documents among many short ones: no range of the curve holds many times the mean."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 2000 if i % 20 == 0 else 20)) for i in range(1500)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("n")).collect()
    counts = [r.n for r in pieces]
    assert max(counts) < 4 * sum(counts) / len(counts)


# --- mixing


def test_targets_by_water_filling(spark):
    rng = random.Random(6)
    for _ in range(5):
        sizes = [rng.choice([0, 5, 50, 1000, 9]) for _ in range(7)]
        sources = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes[:-1])] + [(None, sizes[-1])], "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(sources).collect()}
        weights, caps, left = [(3, 1, 2)[i % 3] for i in range(7)], [2.0 * s for s in sizes], 1.5 * sum(sizes)
        full: set[int] = set()
        while True:
            level = (left - sum(caps[i] for i in full)) / max(sum(w for i, w in enumerate(weights) if i not in full), 1e-9)
            over = {i for i in range(7) if i not in full and level * weights[i] > caps[i]}
            if not over:
                break
            full |= over
        wanted = [caps[i] if i in full else level * weights[i] for i in range(7)]
        assert [got[s] for s in [f"s{i}" for i in range(6)] + [None]] == pytest.approx(wanted, abs=1e-6)


def test_mix_takes_the_budgets(spark, corpus):
    rows = mixing.op8_mixing(spark, corpus).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op8_mixing(spark, corpus).collect()))


def test_a_cut_text_keeps_its_white_space(spark):
    rows = [("a  b\n\nc d", 3, "a  b\n\nc"), ("  a\tb c", 2, "  a\tb"), ("x y", 1, "x"), ("\u00e9 \u4e2d\u6587  z ", 2, "\u00e9 \u4e2d\u6587")]
    got = spark.createDataFrame(rows, "t string, k int, wanted string").select("wanted", mixing.first_words(F.col("t"), F.col("k")).alias("got")).collect()
    assert all(r.got == r.wanted for r in got) and len(got) == 4


def test_mixed_rows_are_what_was_taken(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.op8_mixing(spark, corpus).collect()}
    words = Counter()
    for r in mixing.mixed_rows(docs).collect():
        words[r.doc_id] += len((r.text or "").encode().split())
        assert r.n_chars == len(r.text or "")
    assert {d: n for d, n in words.items() if n} == {d: n for d, n in taken.items() if n}


# --- sharding


def test_shards_are_even_and_slots_gapless(spark, corpus):
    rows = sharding.op9_sharding(spark, corpus).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_by_walking_the_ring(spark, corpus, texts):
    """The whole query: documents one by one in ring order, each arc's own shard first, then clockwise to shards with room."""
    points = sorted((int(hashlib.md5(f"{sharding.SEED}shard {s}, point {v}".encode()).hexdigest()[:8], 16), s) for s in range(24) for v in range(sharding.VNODES))
    places, turn = [p for p, _ in points], points[-1][0] + 1
    arcs = defaultdict(list)
    for i in range(len(texts)):
        key = hashlib.md5(f"{sharding.SEED}{i}".encode()).hexdigest()
        place = int(key[:8], 16)
        arcs[bisect.bisect_left(places, place) % len(points)].append(((place - turn) % 2**32, key[8:], i))
    demand = Counter(points[a][1] for a, docs in arcs.items() for _ in docs)
    room = {s: len(texts) // 24 for s in range(24)}
    for s in sorted(range(24), key=lambda s: -demand[s])[: len(texts) % 24]:
        room[s] += 1
    shard, load, left = {}, Counter(), []
    for a in sorted(arcs):
        for doc in sorted(arcs[a]):
            own = points[a][1]
            if load[own] < room[own]:
                shard[doc[2]] = (own, load[own])
                load[own] += 1
            else:
                left.append((a, doc[2]))
    for a, i in left:
        while load[points[a][1]] == room[points[a][1]]:
            a = (a + 1) % len(points)
        shard[i] = (points[a][1], load[points[a][1]])
        load[points[a][1]] += 1
    rows = sharding.op9_sharding(spark, corpus).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == shard
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 8, zlib.crc32((texts[r.doc_id] or "").encode())) for r in rows)


def test_bytes_law(spark):
    docs = spark.createDataFrame([(i, 1 + i % 97) for i in range(3000)], "uid long, size long")
    rows = sharding.shard_rows(docs, shards=5, law="bytes").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 97
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(5))


def test_one_more_shard_moves_few(spark):
    docs = spark.range(4000).select(F.col("id").alias("uid"), F.lit(8).cast("long").alias("size"))
    place = lambda n: {r.uid: r.shard for r in sharding.shard_rows(docs, shards=n).collect()}
    eight, nine = place(8), place(9)
    moved = sum(eight[k] != nine[k] for k in eight)
    assert moved < 0.45 * len(eight)  # hashing by remainder moves 8 in 9


def test_ring_by_hand():
    pieces = sharding.place_arcs(np.array([5, 0, 1, 0]), np.array([0, 1, 2, 1]), 3)
    # Capacities are two each: shard 0 keeps two of its five, the rest goes clockwise to 1, 1 and 2.
    assert pieces == [(0, 2, 0, 0), (2, 2, 1, 0), (4, 1, 2, 1), (5, 1, 2, 0)]


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><div class="menu-bar nav">Menu</div>
<div class="x">Template text</div><article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>bold</b>text.<p>Three&nbsp;%d &lt;b&gt;<ul><li>item<li>other</ul>
<div class="ad-slot">Buy</div><form>Name<input></form><section id="comments"><p>Nice!</p></section><script>var a="</p>";</script><p>Released under the MIT License.</p></article>
<aside>Side</aside><div role="alert">Cookies</div><footer>Foot</footer></body></html>"""


def test_main_text_of_an_article(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", PAGE % i) for i in range(5)], "page_id long, url string, html string")
    for r in html_text.extract(pages, ["page_id"]).collect():
        assert r.text == f"Head & line\n\nOne two boldtext.\n\nThree {r.page_id} <b>\n\nitem\n\nother\n\nReleased under the MIT License." and r.n_chars == len(r.text)


def test_template_of_a_host_goes(spark):
    """No tag says what is template here: only that it recurs on the host."""
    rng = random.Random(8)
    html = lambda i: f"<body><div><div>Welcome to our place</div><div>{prose(rng, 30)}</div></div><div><p>Tips {'A' if i % 2 else 'B'}</p></div></body>"
    pages = [(i, f"http://a.org/{i}", html(i)) for i in range(12)] + [(100, "http://b.org/", html(0))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert all(len(got[i].split()) == 30 for i in range(12)) and got[100].startswith("Welcome") and got[100].endswith("Tips B")


def test_copies_without_an_article_stay(spark):
    pages = [(i, "http://a.org/", "<body><p>All of it</p></body>") for i in range(6)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id"]).collect()} == {"All of it"}


def test_what_holds_the_main_part_stays():
    text = lambda html: html_text.main_text(*html_text.page_tree(html), set())[0]
    assert text('<form id="aspnetForm"><nav>n</nav><article><p>Whole</p></article></form>') == "Whole"
    assert text('<article><div class="post social-science"><p>Text</p></div></article>') == "Text"
    assert text('<article><p class="notice">a</p><p class="comment-free">b</p><div class="widget">c</div><p>x <math><mi>y</mi></math> z</p></article>') == "a\n\nb\n\nc\n\nx y z"
    assert text('<article><p>a</p><div class="ad-slot">b</div><div class="related-posts">r</div><section class="comments"><article>c</article></section></article>') == "a"
    assert text("<aside><article>teaser</article></aside><article>own</article>") == "own"
    assert text('<article><div class="sponsored">all there is</div></article>') == "all there is"
    assert text("<body><nav>menu only</nav></body>") == "" and text("<body><form><p>asp</p></form><p>a</p></body>") == "asp\n\na"


def extracted(spark, pages):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id"]).collect()}


@pytest.mark.parametrize("copies", [3, 30])
def test_an_article_that_pages_share_stays(spark, copies):
    """With and without an article element, in one piece or in paragraphs, with a table and a section; each page has a line of its own, and a menu all share."""
    rng = random.Random(copies)
    shared, parts = prose(rng, 60), [prose(rng, 12) for _ in range(6)]
    table_ = "<table><tr><td>a1</td><td>b1</td></tr></table><section><p>Shared section</p></section>"
    menu = "<div><a href=/a>News today</a> <a href=/b>All the sport</a></div>"
    bodies = {
        "a.org": (f'<div class="body">{shared}</div>', shared),
        "b.org": (f"<div>{''.join(f'<p>{p}</p>' for p in parts)}{table_}</div>", "\n\n".join([*parts, "a1", "b1", "Shared section"])),
        "c.org": (f"<article>{''.join(f'<p>{p}</p>' for p in parts)}{table_}{menu}</article>", "\n\n".join([*parts, "a1", "b1", "Shared section"])),
        "d.org": ("".join(f"<p>{p}</p>" for p in parts), "\n\n".join(parts)),
    }
    pages, wanted = [], {}
    for host, (body, text) in bodies.items():
        for i in range(copies):
            own = f"Line {i} of its own"
            wanted[len(pages)] = text if host == "c.org" else f"{own}\n\n{text}"
            pages.append((len(pages), f"http://{host}/{i}", f'<body>{menu}<div class="x">{own}</div>{body}</body>'))
    assert extracted(spark, pages) == wanted


def test_comments_adverts_and_controls_go():
    text = lambda html: html_text.main_text(*html_text.page_tree(html), set())[0]
    assert text('<article><p>a</p><section class="reader-comments"><p>c</p></section></article>') == "a"
    assert text('<body><p>a</p><div class="user-comments"><p>c</p></div><div class="advert-300x250">Buy</div><div id="related-stories"><a>r</a></div></body>') == "a"
    assert text("<p>Press <button>OK</button> now, <script>x</script>or <select><option>one<option>two</select> later</p>") == "Press now, or later"
    assert text('<body><a href="#m">Skip to content</a><p>a <a href="#n">note</a></p><a href="/skip">Skip to the moon</a></body>') == "a note\n\nSkip to the moon"
    assert text("<div><p>a <button>never closed</p><p>b</p></div><noscript><div>no</div></noscript>c") == "a\n\nb\n\nc"
    assert text('<article><div class="commentary">kept</div><div class="user-story">kept too</div></article>') == "kept\n\nkept too"


@pytest.mark.parametrize("unit", ["<button>t", "<svg><g>t", "<div>t", "<p>t", "<span class=ad>t", "<a ", "<a b='", "<!--", "<![", "</a ", "<title>", "<b"])
def test_parsing_is_linear(unit):
    began = time.process_time()
    html_text.main_text(*html_text.page_tree(unit * 100_000 + "<p>end</p>"), set())
    assert time.process_time() - began < 20


def test_broken_markup():
    text = lambda html: html_text.main_text(*html_text.page_tree(html), set())[0]
    assert text("a < b & c &lt; d<br>e") == "a < b & c < d e"
    assert text("<![foo><p>x</p><!-- never closed><p>y</p>") == "x\n\ny"
    assert text("<p title='1 > 0'>x</p><p title=it's>y</p><script>var a='<p>no</p>';</script>z") == "x\n\ny\n\nz"
    assert text("<SCRIPT>x</SCRIPT\n><P>One<P>Two<table><tr><td>a<td>b<tr><td>c</table>") == "One\n\nTwo\n\na\n\nb\n\nc"


def site_pages():
    """Pages of three hosts whose template no tag or class tells: some shared by all pages, some by a few, some inside the article."""
    rng, pages = random.Random(8), []
    for host, count in (("a.org", 14), ("b.org", 5), ("c.org", 2)):
        bars = [f"<ul><li><a>{prose(rng, 3)}</a></li><li><a>{prose(rng, 2)}</a></li></ul>" for _ in range(3)]
        line = f"<p>{prose(rng, 6)}</p>"
        for i in range(count):
            own, tail = prose(rng, 30), f"<div><p>{prose(rng, 4)}</p></div>"
            if i % 3 == 0:
                html = f"<body><div>Welcome to {host}</div><div><article><h1>{prose(rng, 3)}</h1>{bars[0]}<p>{own}</p>{line}<ul><li>The list of {host}</li></ul></article></div>{bars[1]}</body>"
            else:
                html = f"<body><div><div>Welcome to {host}</div><div>{own}</div></div>{bars[1]}{bars[2] if i < 4 else tail}</body>"
            pages.append((len(pages), f"https://{host}/{i}", html))
            if i == 1:
                pages.append((len(pages), f"https://{host}/{i}?again", html))
    return pages


def test_templates_by_brute_force(spark):
    from xml.etree import ElementTree

    pages = site_pages()
    inner = lambda e: ElementTree.tostring(e).decode()
    where = defaultdict(set)
    for _, url, html in pages:
        for e in ElementTree.fromstring(html).iter():
            e.tail = None
            where[url.split("/")[2], inner(e)].add(html)

    def text(url, html):
        host, tree = url.split("/")[2], ElementTree.fromstring(html)
        article = tree.find(".//article")
        holding = {e for e in tree.iter() if article is not None and article in e.iter()}
        inside = set(article.iter()) if article is not None else set()
        blocks = []

        def walk(e, kept):
            looked_up = e.tag == "ul" and e.find(".//a") is not None if e in inside else e.tag != "body"
            if kept and looked_up and e not in holding and len(where[host, inner(e)]) >= 3:
                return
            if (e.text or "").strip():
                blocks.append((e in inside, e.text))
            for child in e:
                walk(child, kept)

        walk(tree, True)
        return "\n\n".join(t for main, t in blocks if main or article is None)

    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df, ["page_id"]).collect()}
    assert got == {i: text(url, html) for i, url, html in pages}
    without = {r.page_id: r.text for r in html_text.extract(df, ["page_id"], least_pages=10**9).collect()}
    assert sum(got[i] != without[i] for i in got) >= 15


def test_text_digest_is_of_utf8(make_docs):
    row = exact_dedup.exact_duplicates(make_docs([(1, "ÄbC é")])).first()
    assert row.text_sha256 == hashlib.sha256("Äbc é".encode()).hexdigest()
