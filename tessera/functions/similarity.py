"""Fuzzy string similarity kernels, and one Arrow UDF that computes them for a batch of pairs.

Spark has no built-in for these. Longest common subsequences run bit-parallel in Python integers, and a
worker remembers the pairs of a batch, so repeated names cost once.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & places.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@lru_cache(200_000)
def ratio(a: str, b: str) -> float:
    """Normalised indel similarity in 0..1; two empty strings are equal."""
    if a == b:
        return 1.0
    return 2 * lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 1.0
    shared = " ".join(both)
    left, right = " ".join(both + only_a), " ".join(both + only_b)
    best = ratio(left, right)
    return max(best, ratio(shared, left), ratio(shared, right)) if both else best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, cut windows at the ends included."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(*sorted((a, b), key=len))


def _windows(short: str, long: str) -> float:
    m, n, best = len(short), len(long), 0.0
    letters = set(short)
    for end in range(1, n + m):
        lo, hi = max(0, end - m), min(n, end)
        # a window that doesn't begin and end with a letter of the other can be made shorter without loss
        if long[hi - 1] in letters or long[lo] in letters:
            best = max(best, ratio(short, long[lo:hi]))
            if best == 1.0:
                break
    return best


def partial_token(a: str, b: str) -> float:
    """The better of partial ratios of sorted words and of words that aren't shared; 1 if any is shared."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 1.0
    sorted_a, sorted_b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return max(partial(sorted_a, sorted_b), partial(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    sizes = sorted((len(a), len(b)))
    share = sizes[1] / sizes[0]
    whole = ratio(a, b)
    if share < 1.5:
        return max(whole, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if share <= 8 else 0.6
    return max(whole, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


@lru_cache(200_000)
def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised by a common beginning of up to four letters if it is over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [ch for ch, t in zip(b, taken) if t]
    half = sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * weight * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


FUZZY = ("jw_sim", "token_sort", "token_set", "lev_ratio", "partial_ratio", "wratio", "addr_token_sort", "addr_token_set", "addr_lev_ratio")


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in FUZZY]))
def _fuzzy(core1: pd.Series, core2: pd.Series, name1: pd.Series, name2: pd.Series, addr1: pd.Series, addr2: pd.Series) -> pd.DataFrame:
    rows, known = [], {}
    for key in zip(core1, core2, name1, name2, addr1, addr2):
        if key not in known:
            c1, c2, n1, n2, a1, a2 = key
            addr = (token_sort(a1, a2), token_set(a1, a2), ratio(a1, a2)) if a1 and a2 else (0.0, 0.0, 0.0)
            known[key] = (jaro_winkler(c1, c2), token_sort(n1, n2), token_set(n1, n2), ratio(c1, c2), partial(n1, n2), weighted(n1, n2), *addr)
        rows.append(known[key])
    return pd.DataFrame(rows, columns=list(FUZZY), dtype="float64")


def fuzzy(left: str, right: str) -> Column:
    """A struct of the fuzzy features of two sides, whose columns bear the prefixes."""
    return _fuzzy(*[F.col(f"{side}{c}") for c in ("core", "name", "addr") for side in (left, right)])
