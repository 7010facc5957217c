"""Greedy leader clustering against the loop over titles."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from tidemark.functions import similarity
from tidemark.operators import dedupe, leaders
from tidemark.plans import registry


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def by_ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def by_lcs(a, b):
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    return short / long if short < 0.5 * long else 2 * lcs(a, b) / (short + long)


def greedy(titles, threshold, score=by_ratio):
    """For each title the place of the first leader that it is similar to, or its own."""
    pivots, out = [], []
    for i, t in enumerate(titles):
        out.append(next((j for j in pivots if score(t, titles[j]) >= threshold), i))
        if out[-1] == i:
            pivots.append(i)
    return out


def changed(rng, title):
    chars = list(title)
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(chars) + 1)
        chars[k : k + 1] = rng.choice([[], [rng.choice("abcxyz ")], chars[k : k + 1] + [rng.choice("abc")]])
    return "".join(chars)


def test_lcs_by_bits():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.lcs_length("ab" * 500, "ba" * 500) == 999


@pytest.mark.parametrize("threshold, exact, first, few", [(0.9, True, 2000, 200_000), (0.9, False, 10, 0), (0.8, True, 10, 0), (0.7, False, 25, 3), (0.6, True, 40, 0), (0.4, False, 60, 5)])
def test_leaders_equal_the_loop(spark, monkeypatch, threshold, exact, first, few):
    """Titles made from few others by changes, so that chains of similar ones arise; with small batches, and with all rounds run by Spark."""
    monkeypatch.setattr(leaders, "FIRST_BATCH", first)
    monkeypatch.setattr(leaders, "FEW_PAIRS", few)
    rng = random.Random(int(threshold * 100) + first)
    pool = ["flood in the northern valley", "flood in the southern valley", "quake near the coast", "storm", "ab", ""]
    rows = []
    for i in range(150):
        pool.append(changed(rng, rng.choice(pool)))
        rows.append((i, rng.choice(["A", "B", None]), "flood", pool[-1] if i != 77 else None))
    items = spark.createDataFrame(rows, "ord long, country string, disaster_type string, title string").repartition(5)
    got = {r.ord: r.cluster for r in dedupe.cluster(items, threshold, exact_ratio=exact).collect()}
    assert len(got) == len(rows)
    for country in ("A", "B", None):
        block = [r for r in rows if r[1] == country]
        normal = [" ".join((r[3] or "").lower().split()) for r in block]
        assert [got[r[0]] for r in block] == [block[j][0] for j in greedy(normal, threshold, by_ratio if exact else by_lcs)]


def test_a_chain_is_followed_to_its_end(spark, monkeypatch):
    """Each pair of neighbours is similar: every second title leads, which takes a round each."""
    pairs = spark.createDataFrame([(k + 1, k) for k in range(12)], "a long, b long")
    for few in (0, 3, 100):
        assert sorted(r.n for r in leaders.followers(pairs, few).collect()) == [1, 3, 5, 7, 9, 11]
    assert leaders.followers(pairs.limit(0), 0).collect() == []


def test_a_heap_of_like_titles_is_compared_with_its_leader(spark, monkeypatch):
    """After the first batch a title is paired with leaders only: far fewer pairs than the square of the heap."""
    monkeypatch.setattr(leaders, "FIRST_BATCH", 50)
    seen = []
    plain = leaders.similar_pairs
    monkeypatch.setattr(leaders, "similar_pairs", lambda *a: seen.append(out := plain(*a)) or out)
    titles = [(i, f"heavy rain floods the lower river valley again, report {i:05d}") for i in range(1500)]
    frame = spark.createDataFrame(titles, "ord long, title string")
    got = {r.cluster for r in dedupe.cluster_titles(frame, 0.85).collect()}
    assert got == {0} and sum(p.count() for p in seen) < 1500 * 1499 / 2 / 50


def test_no_titles(spark):
    empty = spark.createDataFrame([], "ord long, country string, disaster_type string, title string")
    assert dedupe.cluster(empty).collect() == [] and dedupe.cluster_titles(empty.select("ord", "title")).collect() == []


def test_unlike_titles_of_one_block(spark):
    rng = random.Random(6)
    titles = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(6))) for i in range(3000)]
    frame = spark.createDataFrame(titles, "ord long, title string")
    assert dedupe.cluster_titles(frame).filter("cluster <> ord").count() == 0


@pytest.mark.parametrize("name, score", [("dd02_greedy_clusters", by_ratio), ("jn05_title_clusters_native", by_lcs)])
def test_queries_equal_the_loop(spark, sf_dir, name, score):
    from tidemark.plans.core_queries import _items

    blocks: dict = {}
    for r in _items(spark, sf_dir).select("ord", "country", "disaster_type", "title").collect():
        blocks.setdefault((r.country, r.disaster_type), []).append((r.ord, " ".join(r.title.lower().split())))
    wanted = {}
    for rows in blocks.values():
        first = {}
        for o, t in sorted(rows):
            first.setdefault(t, o)
        distinct = list(first)
        leader = {distinct[i]: first[distinct[j]] for i, j in enumerate(greedy(distinct, 0.9, score))}
        wanted |= {o: leader[t] for o, t in rows}
    assert {r.ord: r.cluster for r in registry.queries()[name](spark, sf_dir).collect()} == wanted


def test_title_query_equals_the_loop(spark, sf_dir):
    rows = registry.queries()["dd03_title_clusters"](spark, sf_dir).orderBy("ord").collect()
    first = {}
    for r in rows:
        first.setdefault(" ".join(r.title.lower().split()), r.ord)
    distinct = list(first)
    leader = {distinct[i]: first[distinct[j]] for i, j in enumerate(greedy(distinct, 0.9, by_lcs))}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and {r.cluster for r in rows} != {0}
    assert all(r.cluster == leader[" ".join(r.title.lower().split())] for r in rows)


def test_lcs_of_many_pairs():
    rng = random.Random(5)
    for most in (5, 64, 65, 90):
        a, b = (["".join(rng.choice("abcdé 漢") for _ in range(rng.randint(0, most))) for _ in range(300)] for _ in range(2))
        assert similarity.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]
    assert similarity.lcs_lengths([], []).tolist() == [] and similarity.lcs_lengths(["", "a" * 64], ["", "a" * 64]).tolist() == [0, 64]


def test_titles_are_not_broadcast(spark, sf_dir):
    """Tables of titles grow with the input, so none goes through the driver, however small it is here."""
    plan = registry.queries()["dd03_title_clusters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def few_words(rng, n):
    """Unlike titles that share all their q-grams: eight of sixty words each."""
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    return [" ".join(rng.sample(words, 8)) for _ in range(n)]


@pytest.mark.parametrize("step", [500, 1 << 16])
@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.6, 0.75, 0.9, 0.92, 0.9999])
def test_close_pairs_lose_no_similar_pair(monkeypatch, threshold, step):
    """With few pairs at a time, texts are also ordered by their letters."""
    monkeypatch.setattr(similarity, "STEP", step)
    rng = random.Random(int(threshold * 1000))
    pool = ["flood in the northern valley", "漢字 über 😀 é\ud800", "", "a", "ab", "aaaaaaaaaa", "x" * 300, "many words " * 30]
    for _ in range(150):
        pool.append(changed(rng, rng.choice(pool)))
    one, other = pool[::2], pool[1::2]
    got = [(i, j) for p, q in similarity.close_pairs(one, other, threshold) for i, j in zip(p.tolist(), q.tolist())]
    assert len(got) == len(set(got))
    assert set(got) >= {(i, j) for i, a in enumerate(one) for j, b in enumerate(other) if 2 * similarity.lcs_length(a, b) >= threshold * (len(a) + len(b)) - 1e-9}
    if threshold < 0.5:  # SC05 of uneven titles is no common subsequence
        assert len(got) == len(one) * len(other)


def test_close_pairs_are_few():
    titles = few_words(random.Random(8), 3000)
    assert sum(len(p) for p, _ in similarity.close_pairs(titles[:1500], titles[1500:], 0.9)) < 1500 * 1500 / 1000
    assert [list(similarity.close_pairs(a, b, 0.9)) for a, b in (([], []), (["a"], []), ([], ["a"]))] == [[], [], []]


@pytest.mark.parametrize("least, tiles, most", [(40, 16, 1000), (1, 3, 90)])
def test_tiles_of_a_block_meet(spark, monkeypatch, least, tiles, most):
    """Titles of the same few words in one large block, some of them changed a little, beside small blocks."""
    for name, value in (("LEAST_TILE", least), ("TILES", tiles), ("MOST_TILE", most), ("FIRST_BATCH", 100)):
        monkeypatch.setattr(leaders, name, value)
    rng = random.Random(least)
    titles = few_words(rng, 300)
    titles += [changed(rng, rng.choice(titles)) for _ in range(300)]
    rng.shuffle(titles)
    rows = [(i, "A" if i % 10 else f"B{i % 70}", "flood", t) for i, t in enumerate(titles)]
    items = spark.createDataFrame(rows, "ord long, country string, disaster_type string, title string").repartition(4)
    got = {r.ord: r.cluster for r in dedupe.cluster(items, exact_ratio=False).collect()}
    assert len(got) == len(rows) and len(set(got.values())) < 450
    for country in {r[1] for r in rows}:
        block = [r for r in rows if r[1] == country]
        assert [got[r[0]] for r in block] == [block[j][0] for j in greedy([" ".join(r[3].split()) for r in block], 0.9, by_lcs)]


def test_scores_are_those_of_each_pair():
    rng = random.Random(12)
    a, b = ([changed(rng, rng.choice(["", "a", "flood in the valley", "flood in the northern valley again"])) for _ in range(300)] for _ in range(2))
    for threshold in (0.3, 0.5, 0.8, 1.0):
        for score in (similarity.ratio, similarity.lcs_ratio):
            wanted = [score(x, y) >= threshold for x, y in zip([*a, ""], [*b, ""])]
            assert leaders.reaches(score, threshold, [*a, ""], [*b, ""]).tolist() == wanted
