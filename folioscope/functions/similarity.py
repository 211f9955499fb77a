"""Fuzzy text ratios for the few rows that are no plain hit.

The ratios follow the published definitions of normalised indel similarity
(100 * 2 * LCS / total length) and its partial, token-sort and token-set
forms.  They are declared approximations of those of any given library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_WEIGHT = 0.95
PARTIAL_WEIGHT = 0.9
LONG_PARTIAL_WEIGHT = 0.6
LONG_RATIO = 8.0
NEAR_RATIO = 1.5


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(a, b) / total


def _strands(needle: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where the braid of the two strings leaves the bottom: the entry of each column, text columns counted from 0.

    Every cell of the alignment grid is a crossing of a row's and a column's
    strand.  Two strands cross where the characters differ and they have not
    crossed before, else they turn.  The cells of a diagonal do not depend on
    each other, so a diagonal is one vector step; only the two borders are kept.
    A column that a row's strand leaves by is negative.
    """
    n, m = len(needle), len(text)
    rows, columns = np.arange(n), np.arange(n, n + m)
    turned = needle[::-1].copy()
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d)
        h, v = slice(n - 1 - high, n - low), slice(d - high, d - low + 1)
        from_left, from_top = rows[h], columns[v]
        turn = (turned[h] == text[v]) | (from_left > from_top)
        rows[h], columns[v] = np.where(turn, from_top, from_left), np.where(turn, from_left, from_top)
    return columns - n


def _best_window(needle: str, text: str) -> float:
    """Best ratio of the needle with a window of its own length, or a shorter one at either end of the text.

    A window's longest common subsequence is its length less the strands that
    enter and leave inside it, so one braid answers for all windows.  Memory
    follows the sum of the two lengths.
    """
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (needle, text))
    n, m = len(a), len(b)
    entry = _strands(a, b)
    leave = np.flatnonzero(entry >= 0)
    entry = entry[leave]
    low, high = np.maximum(leave - n + 1, 0), np.minimum(entry, m - n)
    inside = low <= high
    change = np.bincount(low[inside], minlength=m + 2).astype(np.int64)
    change[: m + 2] -= np.bincount(high[inside] + 1, minlength=m + 2)[: m + 2]
    whole = n - int(np.cumsum(change)[: m - n + 1].min())
    best = 200.0 * whole / (2 * n)
    if n > 1:
        cut = np.arange(1, n)
        first = cut - np.searchsorted(leave, cut)
        last = cut - (len(entry) - np.searchsorted(np.sort(entry), m - cut))
        best = max(best, float((200.0 * np.maximum(first, last) / (n + cut)).max()))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one."""
    needle, text = (a, b) if len(a) <= len(b) else (b, a)
    if not needle:
        return 100.0 if not text else 0.0
    return 100.0 if needle in text else _best_window(needle, text)


def _token_sort(a: str, b: str, measure) -> float:
    return measure(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str, measure) -> float:
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    only_left = " ".join(sorted(left - right))
    only_right = " ".join(sorted(right - left))
    if shared and (not only_left or not only_right):
        return 100.0
    with_left = f"{shared} {only_left}".strip()
    with_right = f"{shared} {only_right}".strip()
    scores = [measure(with_left, with_right)]
    if shared:
        scores += [measure(shared, with_left), measure(shared, with_right)]
    return max(scores)


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if lengths < NEAR_RATIO:
        return max(best, max(_token_sort(a, b, ratio), _token_set(a, b, ratio)) * TOKEN_WEIGHT)
    weight = PARTIAL_WEIGHT if lengths <= LONG_RATIO else LONG_PARTIAL_WEIGHT
    tokens = 100.0 if set(a.split()) & set(b.split()) else _token_sort(a, b, partial_ratio)
    return max(best, partial_ratio(a, b) * weight, tokens * TOKEN_WEIGHT * weight)


@F.pandas_udf(T.DoubleType())
def _fuzzy_best(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for query, label, text in batches:
        scores = [
            None if q is None or t is None else max(weighted_ratio(q, lab or ""), partial_ratio(q, t))
            for q, lab, t in zip(query, label, text)
        ]
        yield pd.Series(scores, dtype="float64")


def match_score(query: Column, label: Column, text: Column, base: Column, divisor: float = 5.0) -> Column:
    """base + best ratio / 5.

    A text that contains the query has the best ratio by definition, so only
    the other rows are passed to Python (NULLs are skipped there).
    """
    contained = F.contains(text, query)
    rest = F.when(~contained, query)
    fuzzy = _fuzzy_best(rest, label, F.when(~contained, text))
    return base + F.when(contained, F.lit(100.0)).otherwise(fuzzy) / F.lit(divisor)
