"""Title similarity: the one place where a text function needs Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | None, b: str | None) -> float:
    """SC04: matching-blocks ratio 2M/T, 1 for two empty strings."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a character of ``b`` at a time over a vector of bits for all of ``a``."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    # A zero bit is a place of ``a`` where the subsequence grew; a carry moves the growth on to the next place that matches.
    every = open_ = (1 << len(a)) - 1
    for y in b:
        match = open_ & at.get(y, 0)
        open_ = ((open_ + match) | (open_ - match)) & every
    return len(a) - open_.bit_count()


#: Entries of the table of places that ``lcs_lengths`` makes at a time.
PLACES = 1 << 21


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``lcs_length`` of each pair: the same steps for many pairs at once, where the shorter string has 64 characters at most."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.array([-1 if len(x) <= 64 else lcs_length(x, y) for x, y in pairs], dtype=np.int64)
    rest = np.flatnonzero(out < 0)
    codes, letters = pd.factorize(np.frombuffer("".join(c for i in rest for c in pairs[i]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    sizes = np.array([len(c) for i in rest for c in pairs[i]], dtype=np.int64).reshape(-1, 2)
    ends, width = sizes.cumsum(), len(letters) + 1
    step = max(1, PLACES // width)
    for low in range(0, len(rest), step):
        size = sizes[low : low + step]
        n, flat = len(size), size.ravel()
        part = codes[ends[2 * low] - flat[0] : ends[2 * (low + n) - 1]] + 1
        own = np.repeat(np.arange(2 * n), flat)
        place = np.arange(len(part)) - np.repeat(flat.cumsum() - flat, flat)
        first, pair = own % 2 == 0, own // 2
        places = np.zeros(n * width, dtype=np.uint64)  # for each pair and letter the places of the shorter string, as bits
        np.bitwise_or.at(places, pair[first] * width + part[first], np.uint64(1) << place[first].astype(np.uint64))
        steps = np.zeros((size[:, 1].max(), n), dtype=np.int64)  # beyond the end stands a letter without places, which changes nothing
        steps[place[~first], pair[~first]] = part[~first]
        every = np.where(size[:, 0] > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(size[:, 0], 1).astype(np.uint64)), np.uint64(0))
        open_, start = every.copy(), np.arange(n) * width
        for letter in steps:
            match = open_ & places[start + letter]
            open_ = ((open_ + match) | (open_ - match)) & every
        out[rest[low : low + n]] = np.bitwise_count(every & ~open_)
    return out


#: Letters with a count of their own, and counts that the rarer ones share; counts of letter pairs; pairs of texts compared at a time.
LETTERS, GRAMS, STEP = 64, 256, 1 << 16


def close_pairs(one: Sequence[str], other: Sequence[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both, some pairs at a time: all pairs whose twice ``lcs_length`` over both lengths can reach the threshold, and few others.

    Characters without partner are at least as many as the differences of the letters' counts, and each bit "so many of this letter or
    more" that differs stands for one of those. The 64 bits that differ most often tell of nearly all pairs, the next 64 of nearly all of
    the rest. Then letter pairs: M characters with a partner make at least 3M - 1 - (both lengths) common ones, for each character
    without one breaks their row once at most. Thresholds below one half let all pairs through.
    """
    texts, n = [*one, *other], len(one)
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    if not n or n == len(texts):
        return
    letters = pd.factorize(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))[0]
    rank = np.empty(letters.max(initial=-1) + 1, dtype=np.int64)
    rank[np.argsort(-np.bincount(letters), kind="stable")] = np.arange(len(rank))
    letters = rank[letters]
    letters = np.where(letters < LETTERS, letters, LETTERS + letters % LETTERS)
    text, small = np.repeat(np.arange(len(texts)), sizes), np.min_scalar_type(int(sizes.max()))
    counts, grams = np.zeros((len(texts), 2 * LETTERS), dtype=small), np.zeros((len(texts), GRAMS), dtype=small)
    np.add.at(counts.ravel(), text * (2 * LETTERS) + letters, small.type(1))
    inner = text[1:] == text[:-1]
    np.add.at(grams.ravel(), (text[1:] * GRAMS + (letters[:-1] * 37 + letters[1:]) % GRAMS)[inner], small.type(1))

    share = [np.bincount(c)[:0:-1].cumsum()[::-1] / len(texts) for c in counts.T]  # of the texts that have one, two, ... or more
    column, least = np.repeat(np.arange(len(share)), [len(x) for x in share]), np.concatenate([np.arange(1, len(x) + 1) for x in share])
    often = np.concatenate(share)
    best = np.argsort(-often * (1 - often), kind="stable")[:128]
    bits = np.zeros((len(texts), 128), dtype=bool)
    bits[:, : len(best)] = counts[:, column[best]] >= least[best]
    words = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)

    both = np.arange(2 * int(sizes.max()) + 1)
    most = np.minimum((1 - threshold) * both + 1e-6, 255).astype(np.uint8) if threshold >= 0.5 else np.full(len(both), 255, dtype=np.uint8)
    paired = np.ceil(threshold * both / 2 - 1e-6).astype(np.int64)
    common = 3 * paired - 1 - both if threshold >= 0.5 else np.full(len(both), -1)

    def rest(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.minimum(grams[p], grams[q]).sum(axis=1, dtype=np.int64) >= common[sizes[p] + sizes[q]]
        return p[good], q[good] - n

    # Texts in the order of a sum of their letters' counts, each taken as 1 or -1: in that similar ones differ no more than in all counts.
    # The first principal component's signs spread them widely, as languages do; any others would be right.
    place = np.zeros(len(texts), dtype=np.int64)
    if threshold >= 0.5 and n * (len(texts) - n) > STEP:
        spread = np.cov(counts[:: max(1, len(texts) // 4096)].T.astype(np.float64))
        place = (counts.astype(np.float32) @ np.sign(np.linalg.eigh(spread)[1][:, -1]).astype(np.float32)).astype(np.int64)
    rows, columns = np.lexsort((sizes[:n], place[:n])), n + np.lexsort((sizes[n:], place[n:]))
    lengths, places, found, n_found = sizes[columns], place[columns], [], 0
    starts = np.flatnonzero(np.diff(place[rows], prepend=place[rows[0]] - 1) | np.diff(sizes[rows], prepend=-1))
    for alike in np.split(rows, starts[1:]):  # rows of one place and length
        length, middle = sizes[alike[0]], place[alike[0]]
        reach = 2 * (1 - threshold) * length / threshold + 1 if threshold >= 0.5 else 0
        low, high = np.searchsorted(places, [middle - reach, middle + reach + 1])
        if low == high:
            continue
        near, limit = columns[low:high], most[length + lengths[low:high]]
        word, second, step = words[0, near], words[1, near], max(1, STEP // (high - low))
        for k in range(0, len(alike), step):
            some = alike[k : k + step]
            differ = np.bitwise_count(words[0, some][:, None] ^ word)
            at = np.flatnonzero(differ <= limit)
            row, spot = np.divmod(at, high - low)
            good = differ.ravel()[at] + np.bitwise_count(words[1, some][row] ^ second[spot]) <= limit[spot]
            row, spot = row[good], spot[good]
            found.append((some[row], near[spot]))
            n_found += len(row)
            if n_found >= STEP:
                yield rest(*map(np.concatenate, zip(*found)))
                found, n_found = [], 0
    if found:
        yield rest(*map(np.concatenate, zip(*found)))


def lcs_ratio(a: str | None, b: str | None) -> float:
    """SC05: 2 LCS / total length; where one is less than half as long as the other, that share."""
    a, b = a or "", b or ""
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) < 0.5 * max(len(a), len(b)):
        return min(len(a), len(b)) / max(len(a), len(b))
    return 2 * lcs_length(a, b) / (len(a) + len(b))


def _by_pair(score):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


def similarity(a: Column | str, b: Column | str) -> Column:
    """SC04 of two columns."""
    return _by_pair(ratio)(a, b)


def lcs_similarity(a: Column | str, b: Column | str) -> Column:
    """SC05 of two columns."""
    return _by_pair(lcs_ratio)(a, b)


def length_bound(a: Column, b: Column) -> Column:
    """The most that ``similarity`` can be for strings of these lengths: a filter that loses nothing."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))
