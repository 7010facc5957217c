"""Operators 11 to 13 against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex

from tidemark.llm import clustering, common, decontamination, fill_in_middle

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- fill in the middle


def by_hand(doc_id, text, percent=100, suffix_first=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(SHA(f"7:{doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", "one line", "a\n", "\n", "\n\n\n", "a\n\nb\r\nc\n", "ünï \n\x85code 😀\n\U0001f600 end", "with <S> inside\nb\n", "<P", "S>\n<P\n>", "x\n" * 50_000, "y" * 300_000]


@pytest.mark.parametrize("percent, suffix_first", [(100, 50), (30, 80), (0, 50)])
def test_cuts_by_hand(make_docs, percent, suffix_first):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "<", "P", ">", "\n", "é "]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = make_docs(list(enumerate(texts)))
    rows = fill_in_middle.transformed(docs, percent=percent, suffix_first=suffix_first).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, texts[r.doc_id], percent, suffix_first)
        assert r.output_sha256 == SHA(r.output) and r.restored_sha256 == SHA(texts[r.doc_id])
        assert fill_in_middle.restore(r.output, r.form) == texts[r.doc_id]


def test_offsets_are_compact_and_cover_the_text():
    unit = regex.compile(fill_in_middle.UNIT)
    for text in TEXTS:
        ends = fill_in_middle.unit_ends(text, unit)
        assert ends.itemsize == 8 and ends.tolist() == sorted(set(ends)) and (ends[-1] if len(ends) else 0) == len(text)


def test_other_units_and_sentinels(make_docs):
    docs = make_docs([(i, f"One {i}. Two! Three? and a rest  ") for i in range(40)])
    rows = fill_in_middle.transformed(docs, unit=r"[^.!?]+[.!?]", sentinels=("[p]", "[s]", "[m]")).collect()
    assert {r.n for r in rows} == {3} and {r.form for r in rows} == {"psm", "spm"}
    assert all(r.restored_sha256 == SHA(f"One {r.doc_id}. Two! Three? and a rest  ") for r in rows)
    with pytest.raises(ValueError):
        fill_in_middle.transformed(docs, sentinels=("aa", "ab", "ac"))


def test_small_slices_give_the_same(make_docs, monkeypatch):
    docs = make_docs([(i, f"a{i}\nb\nc\n" * i) for i in range(30)])
    whole = sorted(map(tuple, fill_in_middle.transformed(docs).collect()))
    monkeypatch.setattr(fill_in_middle, "SLICE", 10)
    assert sorted(map(tuple, fill_in_middle.transformed(docs).collect())) == whole


# --- centroids


def full_scans(vectors, k, rounds, scale=256):
    """(cluster, squared distance) of each vector and the centroids, in Python's integers."""
    x = [[math.floor(scale * c) for c in v] for v in vectors]
    order = sorted(range(len(x)), key=lambda i: SHA(f"2:{i}"))
    centroids = [x[i] for i in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (dist(v, centroids[j]), j)) for v in x]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            own = [x[i] for i in range(len(x)) if of[i] == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    of = assign()
    return [(of[i], dist(x[i], centroids[of[i]])) for i in range(len(x))], centroids


@pytest.mark.parametrize("spread, k, dims", [(1.0, 8, 4), (0.02, 12, 3), (60.0, 5, 6), (2000.0, 4, 2), (30_000.0, 3, 2)])
def test_clusters_by_full_scans(spark, spread, k, dims):
    """Small spreads make ties, equal centroids and empty clusters; large ones need numbers of 32 bits, and products by integers."""
    rng = random.Random(int(spread * 10))
    vectors = [[float(np.float32(rng.gauss(rng.randrange(5), 0.4) * spread)) for _ in range(dims)] for _ in range(400)]
    vectors += [vectors[0]] * 100
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(5)
    rows, centroids = clustering.clustered(frame, k=k, rounds=4, dims=dims)
    wanted, last = full_scans(vectors, k, 4)
    assert {r.vec_id: (r.cluster, r.distance) for r in rows.collect()} == dict(enumerate(wanted)) and centroids.tolist() == last
    full = clustering.with_inertia(rows, centroids).collect()
    assert {r.inertia for r in full} == {sum(d for _, d in wanted)}
    assert all(r.cluster_inertia == sum(d for c, d in wanted if c == r.cluster) and r.centroid_sha256 == SHA(",".join(map(str, last[r.cluster]))) for r in full)


def test_an_empty_cluster_keeps_its_centroid(spark):
    """Three equal vectors are the centroids; the first takes all, the others stay where they are."""
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    rows, centroids = clustering.clustered(frame, k=3, dims=2)
    assert {r.cluster for r in rows.collect()} == {0} and centroids.tolist() == [[256, 512]] * 3


def test_bounds_settle_most_and_never_wrongly():
    rng = np.random.default_rng(4)
    middle = rng.integers(-2000, 2000, (12, 16))
    v = middle[rng.integers(0, 12, 5000)] + rng.integers(-150, 150, (5000, 16))
    centroids, moved = middle + rng.integers(-300, 300, (12, 16)), np.zeros(12)  # one to a heap, so that few vectors lie between two
    cluster, upper, lower = np.full(5000, -1, dtype=np.int32), np.full(5000, np.inf), np.zeros(5000)
    scans = []
    for _ in range(8):
        cluster, upper, lower, scanned = clustering.reassigned(v, cluster, upper, lower, centroids, moved)
        scans.append(int(scanned.sum()))
        distances = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == distances.argmin(axis=1)).all()
        own = np.sqrt(distances[np.arange(5000), cluster])
        distances[np.arange(5000), cluster] = 1 << 60
        assert (upper >= own).all() and (lower <= np.sqrt(distances.min(axis=1))).all()
        new = np.array([v[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else centroids[j] for j in range(12)])
        moved, centroids = clustering.drifts(centroids, new), new
    assert scans[0] == 5000 and scans[-1] < 250


def test_rounds_leave_only_their_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch", lambda _: f"file://{tmp_path}")
    frame = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(50)], "vec_id long, embedding array<float>")
    clustering.clustered(frame, k=4, dims=2)
    assert [p.name[:9] for p in tmp_path.glob("[!.]*")] == ["clusters-"]


# --- leaks of benchmark items


def leaks(docs, items, window):
    """(n_words, n_hit, item ids) of each document, by looking for every window at every place."""
    words = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("window, shingle, vocabulary", [(10, 5, 40), (10, 5, 3), (4, 2, 6), (5, 5, 5), (3, 5, 4)])
def test_leaks_by_brute_force(spark, make_docs, window, shingle, vocabulary):
    """Few words make repeated shingles, windows that overlap and windows shared by items."""
    rng = random.Random(window * 100 + vocabulary)
    some = [f"w{i}" for i in range(vocabulary - 1)] + ["Ñandú"]
    text = lambda n: "".join(rng.choice(some) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 7, 9, 10, 11, 25]))) for i in range(25)] + [(3, text(12)), (None, text(11)), (26, ""), (27, None)]
    items += [(100 + i, items[5][1] + text(8)) for i in range(5)]
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + [text(20) + x + text(9) for _, x in items[:20] if x] + [items[0][1].upper(), items[5][1][:-3], None, ""]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.decontaminated(make_docs(list(enumerate(docs))), frame, window, shingle).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows}
    assert got == dict(enumerate(leaks(docs, items, window)))
    assert all(r.n_items == len(r.item_ids) and r.contaminated == (r.n_hit > 0) for r in rows) and len(rows) == len(docs)


def test_a_full_bitmap_loses_nothing(spark, make_docs, monkeypatch):
    """With 64 bits for hundreds of shingles all places pass, and the join decides."""
    rng = random.Random(2)
    some = [f"w{i}" for i in range(9)]
    text = lambda n: " ".join(rng.choice(some) for _ in range(n))
    items, docs = [(i, text(30)) for i in range(20)], [text(50) for _ in range(30)]
    docs += [items[k][1] for k in range(5)]
    monkeypatch.setattr(decontamination, "MOST_BITS", 6)
    rows = decontamination.decontaminated(make_docs(list(enumerate(docs))), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows} == dict(enumerate(leaks(docs, items, 10)))


def test_the_prefix_is_the_rarest_shingle(spark):
    shingles = spark.createDataFrame([(10, ["w"], k, h) for k, h in enumerate([5, 6, 7, 8, 9, 5])], "size int, win array<string>, offset int, h long")
    places = spark.createDataFrame([(h,) for h in [5, 5, 6, 7, 7, 8, 8, 8, 9, 9]], "h long")
    assert [(r.h, r.offset) for r in decontamination.rarest(shingles, places).collect()] == [(6, 1)]
    assert [(r.h, r.offset) for r in decontamination.rarest(shingles, places.filter("h <> 9")).collect()] == [(9, 4)]


def test_the_bitmap_holds_its_hashes(spark):
    hashes = spark.createDataFrame([(h,) for h in (-1, 0, 1 << 62, -(1 << 63), 12345678901234567)], "h long")
    bits = decontamination.bitmap(hashes, 12).first()["bits"]
    places = {((h & (1 << 64) - 1) >> 52) for h in (-1, 0, 1 << 62, -(1 << 63), 12345678901234567)}
    assert {64 * i + k for i, b in enumerate(bits) for k in range(64) if b >> k & 1} == places and len(bits) == 64


def test_documents_run_without_python(spark, make_docs):
    frame = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontamination.decontaminated(make_docs([(1, "a b c d")]), frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
