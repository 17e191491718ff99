"""Similarities of strings, sets and vectors, all between 0 and 1."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import grams


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Equal 1, one empty 0, a prefix its share, long strings by trigrams, others by edit distance."""
    la, lb = F.length(a), F.length(b)
    long, short = F.greatest(la, lb), F.least(la, lb)
    return (
        F.when(a == b, F.lit(1.0))
        .when(short == 0, F.lit(0.0))
        .when(F.startswith(a, b) | F.startswith(b, a), short / long)
        .when(long > 80, jaccard(grams(a), grams(b)))
        .otherwise(1.0 - F.levenshtein(a, b) / long)
    )


def containment(a: Column, b: Column) -> Column:
    return (F.contains(a, b) | F.contains(b, a)).cast("double")


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b).cast("double")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def logit(t: Column) -> Column:
    c = F.least(F.greatest(t, F.lit(0.01)), F.lit(0.99))
    return F.log(c / (1.0 - c))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 or more positions at a time in one integer."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & at.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of characters in a longest common subsequence; 1 for two empty strings."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, ax, by = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not ax or not by):
        return 1.0
    base = " ".join(both)
    one, two = " ".join([*both, *ax]), " ".join([*both, *by])
    return max(ratio(one, two), ratio(base, one) if base else 0.0, ratio(base, two) if base else 0.0)


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer, overhanging windows included."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return float(not b)
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def weighted(a: str, b: str) -> float:
    """The best of the ratios, with partial ones where the lengths differ by half or more."""
    if not a or not b:
        return 0.0
    span = max(len(a), len(b)) / min(len(a), len(b))
    if span < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if span <= 8 else 0.6
    sorted_ = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    x, y = set(a.split()), set(b.split())
    shared = 1.0 if x & y else partial(" ".join(sorted(x)), " ".join(sorted(y)))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * max(sorted_, shared))


#: Pairs of strings that are compared at once; a shorter string of more characters than a word has bits is compared alone.
AT_ONCE, BITS = 512, 64


def _masks(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each pair and place of ``b``, the places of ``a`` with the same character, as bits; none beyond ``b``."""
    x, y = (np.array(s, dtype=f"U{w}").view(np.uint32).reshape(len(s), w) for s, w in ((a, max(1, n.max())), (b, max(1, m.max()))))
    bits = np.packbits(x[:, None, :] == y[:, :, None], axis=2, bitorder="little")
    out = np.zeros((*bits.shape[:2], 8), np.uint8)
    out[:, :, : bits.shape[2]] = bits
    out = out.view(np.uint64)[:, :, 0] & _full(n)[:, None]
    out[np.arange(y.shape[1]) >= m[:, None]] = 0
    return out


def _full(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.uint64(2**64 - 1) >> (BITS - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))


def _step(row: np.ndarray, mask: np.ndarray) -> np.ndarray:
    met = row & mask
    return row + met | row - met


def _by_length(a: list[str], b: list[str], one: Callable[[str, str], float], many: Callable[[list[str], list[str], np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``many`` over pairs of like lengths, the shorter string first; ``one`` for those it cannot take."""
    out = np.empty(len(a))
    short = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    n, m = (np.array([len(p[j]) for p in short], np.int64) for j in (0, 1))
    fits = (n > 0) & (n <= BITS) & (m <= 4 * BITS)
    for i in np.flatnonzero(~fits):
        out[i] = one(*short[i])
    order = np.flatnonzero(fits)
    order = order[np.lexsort((m[order], -n[order]))]
    for at in range(0, len(order), AT_ONCE):
        own = order[at : at + AT_ONCE]
        out[own] = many([short[i][0] for i in own], [short[i][1] for i in own], n[own], m[own])
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of many pairs."""

    def many(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
        masks, full = np.ascontiguousarray(_masks(a, b, n, m).T), _full(n)
        row = full.copy()
        for mask in masks:
            row = _step(row, mask)
        return 2 * (n - np.bitwise_count(row & full)) / (n + m)

    return _by_length(a, b, ratio, many)


def partials(a: list[str], b: list[str]) -> np.ndarray:
    """``partial`` of many pairs: all windows of a length are gone through together, overhanging ones in one pass from either end."""

    def overhanging(masks: np.ndarray, n: np.ndarray) -> np.ndarray:
        full, best = _full(n), np.zeros(len(n))
        row = full.copy()
        for j in range(n[0] - 1):
            row = _step(row, masks[:, j])
            best = np.maximum(best, np.where(j + 1 < n, 2 * (n - np.bitwise_count(row & full)) / (n + j + 1), 0.0))
        return best

    def many(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
        masks = _masks(a, b, n, m)
        best = np.maximum(overhanging(masks, n), overhanging(_masks([x[::-1] for x in a], [x[::-1] for x in b], n, m), n))
        windows = m - n + 1
        pair = np.repeat(np.arange(len(n)), windows)
        at = pair * masks.shape[1] + np.arange(len(pair)) - np.repeat(np.cumsum(windows) - windows, windows)
        row, flat = _full(n)[pair], masks.ravel()
        for j in range(n[0]):  # longest first
            k = np.searchsorted(-n, -j)
            k = windows[:k].sum()
            row[:k] = _step(row[:k], flat[at[:k] + j])
        lcs = n[pair] - np.bitwise_count(row & _full(n)[pair])
        whole = np.maximum.reduceat(lcs, np.cumsum(windows) - windows)
        return np.maximum(best, 2 * whole / (2 * n))

    return _by_length(a, b, partial, many)


def _sorted_words(strings: list[str]) -> list[str]:
    return [" ".join(sorted(x.split())) for x in strings]


def token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    return ratios(_sorted_words(a), _sorted_words(b))


def token_sets(a: list[str], b: list[str]) -> np.ndarray:
    """``token_set`` of many pairs; what both have begins either side, so it is all of their common subsequence."""
    out, at, ones, twos = np.zeros(len(a)), [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = set(p.split()), set(q.split())
        if not x or not y:
            continue
        both, ax, by = sorted(x & y), sorted(x - y), sorted(y - x)
        if both and (not ax or not by):
            out[i] = 1.0
            continue
        base, one, two = " ".join(both), " ".join([*both, *ax]), " ".join([*both, *by])
        if base:
            out[i] = max(2 * len(base) / (len(base) + len(one)), 2 * len(base) / (len(base) + len(two)))
        at.append(i)
        ones.append(one)
        twos.append(two)
    if at:
        out[at] = np.maximum(out[at], ratios(ones, twos))
    return out


def weighteds(a: list[str], b: list[str]) -> np.ndarray:
    """``weighted`` of many pairs."""
    out = np.zeros(len(a))
    lengths = [(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    span = np.array([max(x) / min(x) if min(x) else 0.0 for x in lengths])
    pick = lambda at: ([a[i] for i in at], [b[i] for i in at])
    near, far = np.flatnonzero((span > 0) & (span < 1.5)), np.flatnonzero(span >= 1.5)
    if len(near):
        x, y = pick(near)
        out[near] = np.maximum(ratios(x, y), 0.95 * np.maximum(token_sorts(x, y), token_sets(x, y)))
    if len(far):
        x, y = pick(far)
        scale = np.where(span[far] <= 8, 0.9, 0.6)
        p, q = [x.split() for x in x], [y.split() for y in y]
        sets = np.ones(len(far))  # with a shared word
        rest = [i for i, (u, v) in enumerate(zip(p, q, strict=True)) if set(u).isdisjoint(v)]
        if rest:
            words = [[" ".join(sorted(w[i])) for i in rest] for w in (p, q)]
            sets[rest] = partials(*words)
            # without repeated words the sets are the lists
            repeats = [i for i in rest if len(set(p[i])) < len(p[i]) or len(set(q[i])) < len(q[i])]
            if repeats:
                sets[repeats] = np.maximum(sets[repeats], partials(*([" ".join(sorted(set(w[i]))) for i in repeats] for w in (p, q))))
        out[far] = np.maximum(np.maximum(ratios(x, y), scale * partials(x, y)), 0.95 * scale * sets)
    return out


def fuzzy(name: str):
    """An Arrow function of two string columns: ratio, token_sort, token_set, partial or weighted."""
    many = {"ratio": ratios, "token_sort": token_sorts, "token_set": token_sets, "partial": partials, "weighted": weighteds}[name]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        # equal pairs of a batch are scored once
        pairs = [(x or "", y or "") for x, y in zip(a, b, strict=True)]
        known = {p: 1.0 for p in pairs}
        open_ = [p for p in known if not p[0] or p[0] != p[1]]
        if open_:
            known.update(zip(open_, many([p[0] for p in open_], [p[1] for p in open_]).tolist(), strict=True))
        return pd.Series([known[p] for p in pairs], dtype="float64")

    return run
