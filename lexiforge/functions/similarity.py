"""Similarity of two words, as columns; the common subsequence alone needs Python."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexiforge.functions.text import lower_cp

LONGER_WORSE, ANY_MISMATCH, WEIGHTED = "longer_worse", "any_mismatch", "weighted"


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix; the first character of b is compared in lower case as well."""
    size = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(a, F.lit(2), i - 1) == F.substr(b, F.lit(2), i - 1))
    first = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) | (F.substring(a, 1, 1) == lower_cp(F.substring(b, 1, 1)))
    return F.when((size == 0) | ~first, 0).otherwise(F.size(F.filter(same, lambda i: i <= size)))


def common_positions(a: Column, b: Column) -> Column:
    """Number of positions with equal characters."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.length(F.substr(a, i, F.lit(1))) > 0)))


def is_swap(a: Column, b: Column) -> Column:
    """Whether two words of one length differ by exchanging two characters."""
    apart = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    at = lambda w, k: F.substr(w, F.get(apart, F.lit(k)), F.lit(1))
    return (F.length(a) == F.length(b)) & (F.size(apart) == 2) & F.coalesce((at(a, 0) == at(b, 1)) & (at(a, 1) == at(b, 0)), F.lit(False))


def ngram(n: int, a: Column, b: Column, *modes: str) -> Column:
    """Positions of ``a`` whose j-gram occurs in ``b``, summed over j up to n, less a length penalty.

    Levels stop when one scores below 2, unless weighted; weighted levels lose a
    point for each miss and another for a miss at either end.
    """
    weighted = WEIGHTED in modes
    size = F.length(a)

    def level(j: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: i <= size - j + 1)
        there = lambda i: F.contains(b, F.substr(a, i, j))
        hits = F.size(F.filter(starts, there))
        if not weighted:
            return hits
        misses = F.filter(starts, lambda i: ~there(i))
        ends = F.size(F.filter(misses, lambda i: (i == 1) | (i == size - j + 1)))
        return hits - F.size(misses) - ends

    def step(s: Column, j: Column) -> Column:
        found = level(j)
        stop = F.lit(False) if weighted else found < 2
        return F.when(s["stop"], s).otherwise(F.struct((s["total"] + found).alias("total"), stop.alias("stop")))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.struct(F.lit(0).alias("total"), F.lit(False).alias("stop")), step, lambda s: s["total"])
    longer = F.length(b) - size
    over = F.lit(0)
    if LONGER_WORSE in modes:
        over = longer - 2
    if ANY_MISMATCH in modes:
        over = F.abs(longer) - 2
    return F.when(F.length(b) == 0, 0).otherwise(total - F.greatest(over, F.lit(0)))


def _ngram(n: int, a: str, b: str, longer_worse: bool, any_mismatch: bool, weighted: bool) -> int:
    if not b:
        return 0
    total = 0
    for j in range(1, n + 1):
        starts = range(len(a) - j + 1)
        hits = sum(a[i : i + j] in b for i in starts)
        if weighted:
            missed = len(starts) - hits
            ends = sum(a[i : i + j] not in b for i in {0, len(a) - j} if i in starts)
            total += hits - missed - ends
        else:
            total += hits
            if hits < 2:
                break
    over = len(b) - len(a) - 2 if longer_worse else abs(len(b) - len(a)) - 2 if any_mismatch else 0
    return total - max(over, 0)


def ngram_batched(n: int, *modes: str) -> Callable[[Column, Column], Column]:
    """:func:`ngram` over Arrow batches, for many pairs: several times faster than the expression."""
    chosen = LONGER_WORSE in modes and ANY_MISMATCH not in modes, ANY_MISMATCH in modes, WEIGHTED in modes

    @F.pandas_udf(IntegerType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _ngram(n, x, y, *chosen) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return score


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, one row of the table at a time."""

    def one(x: str, y: str) -> int:
        row = [0] * (len(y) + 1)
        for c in x:
            left = 0
            for j, d in enumerate(y, 1):
                above, row[j] = row[j], left + 1 if c == d else max(row[j], row[j - 1])
                left = above
        return row[-1]

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
