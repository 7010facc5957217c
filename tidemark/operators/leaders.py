"""Greedy leader clustering of titles (DD02, DD03, JN05), as rounds over pairs that can be similar.

In order of arrival a title joins the first leader that it is similar enough to, or leads a cluster itself. Whether a title leads
depends on earlier titles that are similar to it, and on no others: the leaders are the lexicographically first independent set of
the graph of similar titles. So only pairs whose letters allow it are scored (``close_pairs``; none that is similar enough is lost),
and the choice is made in rounds: who has no earlier neighbour leads, who has a leading one follows and leaves the graph, which
frees others.

Titles come in batches, each of which makes their number four times as large. A batch is compared with the leaders so far first,
and only titles that follow none of these are paired among themselves. So a heap of like titles is compared with its few leaders
rather than pair by pair, and what a batch pairs among itself are titles that the ones before did not foresee.

A block's titles are dealt over tiles, and each pair of tiles is a group of its own: a task holds two tiles. Titles made of the same
few words share all their q-grams, which tell none of them apart; so letters are compared, of all pairs in a block, at a few
nanoseconds a pair. That is quadratic in the unlike titles of a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import close_pairs, lcs_lengths, lcs_ratio
from tidemark.functions.text import let
from tidemark.sources.shared import written

#: Titles of the first batch, and by how much each further one makes them more.
FIRST_BATCH, GROWTH = 1_000, 4
#: When so few pairs are undecided, one task follows their chains to the end.
FEW_PAIRS = 200_000
#: Titles of a tile: so many at least, up to so many tiles of a block, and so many at most.
LEAST_TILE, TILES, MOST_TILE = 4_096, 16, 32_768
#: Blocks with no more than this share of all titles are a tile each.
SMALL_BLOCK = 1 / 1000

#: The longest q-grams that titles are looked up by.
LONGEST_GRAM = 5


def shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: titles, grams and pairs grow with the input, and a broadcast takes them through the driver."""
    return rows.hint("merge")


def gram_lengths(threshold: float) -> dict[int, tuple[float, float]]:
    """For each q: the shortest title that is looked up by q-grams, and the share of its length that a similar one of another wording lacks of them."""
    lacks = lambda q, r: q + (q - 1) * r - (2 * q - 1) * threshold * (1 + r) / 2
    worst = {q: max(lacks(q, threshold / (2 - threshold)), lacks(q, (2 - threshold) / threshold)) for q in range(1, LONGEST_GRAM + 1)}
    # A title must keep a gram; the shortest that can have a similar one of another wording is looked up by characters.
    return {1: (threshold / (2 * (1 - threshold)) - 1e-9, worst[1])} | {q: (q / (1 - w), w) for q, w in worst.items() if q > 1 and w < 1}


def rare_grams(titles: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(t, first, by...) with gram: as many of a title's rarest q-grams as a similar title of another wording must share one of.

    Of the q-grams of a title of length n, one similar to it at the threshold lacks n - M (characters without partner) times q,
    and q - 1 for each of its own characters without one, at most; M, the characters with a partner, is at least the threshold
    times half of both lengths, and these differ by the factor (2 - t) / t at most. If it lacks no more than k, and the
    other way round, then the k + 1 rarest ones of each have one in common. Repeated grams are told apart by number. That holds for
    any partners in one order, and so for both measures. How rare a gram is, is counted within ``by``.

    Two titles are looked up by the longest grams that the shorter one can afford, so a title has those of its own length and of the
    shortest length that a similar one can have.
    """
    if threshold >= 1:
        return titles.select("t", "first", *by, F.lit("").alias("gram")).limit(0)
    lengths = gram_lengths(threshold)
    n = F.char_length("t")

    def longest(length: Column) -> Column:
        out = F.lit(1)
        for q in sorted(lengths)[1:]:
            out = F.when(length >= lengths[q][0], q).otherwise(out)
        return out

    own = titles.filter(n >= lengths[1][0]).withColumn("q", F.explode(F.sequence(longest(n * (threshold / (2 - threshold)) - 1e-9), longest(n))))
    grams = F.transform(F.sequence(F.lit(1), n - (F.col("q") - 1)), lambda i: F.substring("t", i, F.col("q")))
    number = lambda gs, g, i: F.size(F.filter(F.slice(gs, F.lit(1), i), lambda other: other == g))
    numbered_grams = let(grams, lambda gs: F.transform(gs, lambda g, i: F.concat(F.col("q").cast("string"), F.lit(":"), g, F.lit("#"), number(gs, g, i).cast("string"))))
    each = own.select("t", "first", *by, "q", F.explode(numbered_grams).alias("gram"))
    times = each.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("times"))
    share = F.element_at(F.create_map(*[F.lit(x) for q, (_, w) in lengths.items() for x in (q, w)]), F.col("q"))
    most = F.floor(share * n + 1e-9).cast("int") + 1
    ranked = each.join(shuffled(times), [*by, "gram"]).groupBy("t", "first", *by, "q").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("all"))
    return ranked.select("t", "first", *by, F.explode(F.slice("all", F.lit(1), most)).alias("g")).select("t", "first", *by, "g.gram")


def reaches(score: Callable[[str, str], float], threshold: float, a: list[str], b: list[str]) -> np.ndarray:
    """Whether the score of two titles is at least the threshold: SC05 by their longest common subsequences, SC04 by itself where these allow it."""
    la, lb = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    common, whole = lcs_lengths(a, b), la + lb
    if score is lcs_ratio:
        short, long = np.minimum(la, lb), np.maximum(la, lb)
        return np.where(2 * short < long, short / np.maximum(long, 1), np.where(whole > 0, 2 * common / np.maximum(whole, 1), 1.0)) >= threshold
    good = 2 * common >= threshold * whole - 1e-9
    good[good] = [score(a[i], b[i]) >= threshold for i in np.flatnonzero(good)]
    return good


def large_blocks(titles: DataFrame, total: int) -> dict[str, int]:
    """Titles of the blocks that need more than one tile, which are a thousand at most."""
    sizes = titles.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return {r.block: r.n for r in sizes.filter(F.col("n") > max(LEAST_TILE, SMALL_BLOCK * total)).collect()}


def tiles_of(blocks: dict[str, int], share: float = 1.0) -> Column:
    """Tiles of a row's block, of which the given share of the titles is there."""
    tiles = {b: max(min(TILES, math.ceil(n * share / LEAST_TILE)), math.ceil(n * share / MOST_TILE)) for b, n in blocks.items()}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in tiles.items() for x in pair])[F.col("block")], F.lit(1)) if tiles else F.lit(1)


def similar_pairs(later: DataFrame, earlier: DataFrame, score: Callable[[str, str], float], threshold: float, later_tiles: Column, earlier_tiles: Column) -> DataFrame:
    """(a, b) of the titles (t, first, block) that share a block, the second before the first, and are similar enough.

    The two sides are one table, or the second is before the first as a whole.
    """
    same = later is earlier
    tile = lambda tiles: F.pmod(F.xxhash64("first"), tiles).cast("int")
    one = later.select("block", "first", "t", F.lit(True).alias("late"), tile(later_tiles).alias("i"))
    other = earlier.select("block", "first", "t", F.lit(False).alias("late"), tile(earlier_tiles).alias("j"))
    # Of one table, the pair of tiles (j, i) is that of (i, j).
    one = one.withColumn("j", F.explode(F.sequence(F.col("i") if same else F.lit(0), earlier_tiles - 1)))
    other = other.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if same else later_tiles - 1)))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(frames), ignore_index=True)
        first, t, late = both["first"].to_numpy(), both["t"].to_numpy(), both["late"].to_numpy()
        own = same and both["i"].iat[0] == both["j"].iat[0]
        sides = np.flatnonzero(late), np.flatnonzero(~late)
        for p, q in close_pairs(t[sides[0]], t[sides[1]], threshold):
            p, q = sides[0][p], sides[1][q]
            if own:
                p, q = p[first[p] > first[q]], q[first[p] > first[q]]
            p, q = np.where(first[p] > first[q], p, q), np.where(first[p] > first[q], q, p)
            good = reaches(score, threshold, t[p].tolist(), t[q].tolist())
            yield pd.DataFrame({"a": first[p[good]], "b": first[q[good]]})

    tasks = max(64, int(later.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return one.unionByName(other).repartition(tasks, "block", "i", "j").groupBy("block", "i", "j").applyInPandas(compare, "a long, b long")


def followers(pairs: DataFrame, few: int | None = None) -> DataFrame:
    """(n): the titles of (a, b), b before a, that some leader is similar to."""
    few = FEW_PAIRS if few is None else few

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[int] = set()
        rest = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *frames])
        for a, of_a in rest.sort_values("a").groupby("a")["b"]:
            if not found.issuperset(of_a):
                found.add(a)
        yield pd.DataFrame({"n": sorted(found)}, dtype="int64")

    parts, rest = [], pairs
    while (left := rest.count()) > few:
        leading = rest.select(F.col("b").alias("n")).distinct().join(shuffled(rest.select(F.col("a").alias("n")).distinct()), "n", "left_anti")
        follow = written(rest.join(shuffled(leading), rest.b == leading.n, "left_semi").select(F.col("a").alias("n")).distinct(), "followers")
        parts.append(follow)
        rest = written(rest.join(shuffled(follow), rest.a == follow.n, "left_anti").join(shuffled(follow), F.col("b") == follow.n, "left_anti"), "undecided")
    if left:
        parts.append(rest.coalesce(1).mapInPandas(finish, "n long"))
    return reduce(DataFrame.unionByName, parts) if parts else pairs.select(F.col("a").alias("n"))


def leading_titles(titles: DataFrame, threshold: float, score: Callable[[str, str], float]) -> DataFrame:
    """(block, t, first) of distinct titles to (block, t, cluster): the ``first`` of the title that leads each.

    Titles of equal ``first`` are in order of their wording. Thresholds below one half have no filter: all pairs of a block are scored.
    """
    place = titles.orderBy("first", "t").select("block", "t", F.col("first").alias("arrived"), F.monotonically_increasing_id().alias("first"))
    ranked = written(place, "titles")
    total = ranked.count()
    sizes = [FIRST_BATCH]
    while sizes[-1] * GROWTH < total:
        sizes.append(sizes[-1] * GROWTH)
    shares = [s / total for s in sizes if s < total]
    cuts = ranked.agg(F.percentile_approx("first", shares, 10_000)).first()[0] if shares else []
    plain, blocks = ranked.select("t", "first", "block"), large_blocks(ranked, total)
    parts: list[DataFrame] = []
    for low, high, before, until in zip([None, *cuts], [*cuts, None], [0, *shares], [*shares, 1]):
        batch = plain
        batch = batch if low is None else batch.filter(F.col("first") > low)
        batch = batch if high is None else batch.filter(F.col("first") <= high)
        tiles = tiles_of(blocks, until - before)
        if parts:
            led = reduce(DataFrame.unionByName, parts).select(F.col("a").alias("first"))
            leading = plain.filter(F.col("first") <= low).join(shuffled(led), "first", "left_anti")
            known = similar_pairs(batch, leading, score, threshold, tiles, tiles_of(blocks, before))
            parts.append(written(known.groupBy("a").agg(F.min("b").alias("b")), "led"))
            batch = written(batch.join(shuffled(parts[-1].select(F.col("a").alias("first"))), "first", "left_anti"), "batch")
        pairs = written(similar_pairs(batch, batch, score, threshold, tiles, tiles), "title-pairs")
        follow = followers(pairs)
        own = pairs.join(shuffled(follow), pairs.b == follow.n, "left_anti").groupBy("a").agg(F.min("b").alias("b"))
        parts.append(own if high is None else written(own, "led"))
    led = reduce(DataFrame.unionByName, parts).join(shuffled(ranked.select(F.col("first").alias("b"), F.col("arrived").alias("cluster"))), "b").select(F.col("a").alias("first"), "cluster")
    return ranked.join(shuffled(led), "first", "left").select("block", "t", F.coalesce("cluster", "arrived").alias("cluster"))
