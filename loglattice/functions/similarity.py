"""Similarity and distance of token lists and texts: built-in expressions where they can say it, pandas functions otherwise."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WILD = "<*>"


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding n-grams joined by a zero character; none if there are fewer tokens. Built from n shifted copies, in time linear in the tokens."""
    many = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    out = F.transform(F.slice(tokens, 1, many), lambda t: F.coalesce(t, F.lit("")))
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, many), lambda g, t: F.concat_ws("\0", g, t))
    return F.when(F.size(tokens) >= n, out).otherwise(F.array().cast("array<string>"))


def ngram_similarity(a: Column, b: Column, n: int) -> Column:
    """Dice coefficient of the n-gram sets; 1 for two empty ones."""
    return 1 - ngram_distance(a, b, n)


def ngram_distance(a: Column, b: Column, n: int) -> Column:
    x, y = F.array_distinct(ngrams(a, n)), F.array_distinct(ngrams(b, n))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, (total - 2 * F.size(F.array_intersect(x, y))) / total.cast("double")).otherwise(0.0)


def jaccard_distance(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, 1 - F.size(F.array_intersect(a, b)) / both.cast("double")).otherwise(0.0)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(a, b) / longest.cast("double")).otherwise(0.0)


def multiset_cosine_distance(a: Column, b: Column) -> Column:
    """1 - |A∩B| / sqrt(|A||B|) of multisets."""

    def common(x: Column) -> Column:
        count = lambda of, v: F.size(F.filter(of, lambda t: t == v))
        return F.aggregate(F.array_distinct(x), F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v)))

    size = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(size > 0, 1 - common(a) / size).otherwise(F.when(F.size(a) == F.size(b), 0.0).otherwise(1.0))


def euclidean(a: Column, b: Column) -> Column:
    """Norm of the difference by the number of components."""
    n = F.size(a)
    return F.when(n > 0, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)) / n).otherwise(0.0)


def lcs(a: list, b: list) -> tuple[int, list]:
    """Length of the longest common subsequence, and the template of it with wildcards for the gaps."""
    n, m = len(a), len(b)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            size[i][j] = size[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(size[i - 1][j], size[i][j - 1])
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        else:
            if not out or out[-1] != WILD:
                out.append(WILD)
            i, j = (i - 1, j) if size[i - 1][j] >= size[i][j - 1] else (i, j - 1)
    if (i or j) and (not out or out[-1] != WILD):
        out.append(WILD)
    return size[n][m], out[::-1]


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(list(x), list(y))[0] for x, y in zip(a, b)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def lcs_template(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(list(x), list(y))[1] for x, y in zip(a, b)])


def lcs_distance(a: Column, b: Column, symmetric: bool = False) -> Column:
    """1 - lcs / |a|, or symmetric: 1 - 2 lcs / (|a| + |b|)."""
    if symmetric:
        total = F.size(a) + F.size(b)
        return F.when(total > 0, 1 - 2 * lcs_length(a, b) / total.cast("double")).otherwise(0.0)
    return F.when(F.size(a) > 0, 1 - lcs_length(a, b) / F.size(a).cast("double")).otherwise(0.0)


def mixed_distance(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Mean of the LCS distance of sequences and the Euclidean distance of their vectors."""
    return (lcs_distance(a, b) + euclidean(x, y)) / 2


@F.pandas_udf(T.DoubleType())
def ratcliff_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1 - SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def _entropy(counts: Counter) -> float:
    import math

    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


@F.pandas_udf(T.DoubleType())
def entropy_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalized compression distance with 1 + the entropy of the characters as the size."""

    def one(x: str, y: str) -> float:
        if x == y:
            return 0.0
        e, f, both = 1 + _entropy(Counter(x)), 1 + _entropy(Counter(y)), 1 + _entropy(Counter(x + y))
        return (both - min(e, f)) / max(e, f)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def gap_match(template: list, row: list) -> list[list] | None:
    """The variable parts of a row if the template's pieces occur in order in it, else None; the first and last piece are anchored unless a wildcard stands there."""
    if Counter(t for t in template if t != WILD) - Counter(row):
        return None
    pieces: list[list] = [[]]
    for t in template:
        if t == WILD:
            pieces.append([])
        else:
            pieces[-1].append(t)
    head, *rest = pieces
    if row[: len(head)] != head or not rest and len(row) != len(head):
        return None
    at, out = len(head), []
    for k, piece in enumerate(rest):
        last = k == len(rest) - 1
        places = range(at, len(row) - len(piece) + 1)
        hit = (len(row) - len(piece) if len(row) - len(piece) >= at and row[len(row) - len(piece) :] == piece else None) if last and piece else len(row) if last else next((p for p in places if row[p : p + len(piece)] == piece), None)
        if hit is None:
            return None
        out.append(row[at:hit])
        at = hit + len(piece)
    return out


def folded_template(rows: list[list]) -> list:
    """LCS template of all members of a cluster, consecutive wildcards collapsed. Gaps stay: a wildcard of the template equals nothing in a row."""
    template = list(rows[0])
    for row in rows[1:]:
        template = lcs(template, row)[1]
    return template
