"""Vector and string similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2_normalize(a: Column) -> Column:
    """Of length 1; a vector of no length stays as it is. The length is computed once a vector."""
    of = lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
    return F.get(F.transform(F.array(norm(a)), of), F.lit(0))


# ---------------------------------------------------------------- strings


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity, 0 to 100; two empty strings are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with an equally long (or clipped) part of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    best = max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))
    return max(best, max(ratio(b[i : i + n], a) for i in range(max(1, len(b) - n + 1)))) if len(a) == len(b) else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    both, only_a, only_b = _token_parts(a, b)
    if not a.split() or not b.split():
        return 0.0
    if both and (not only_a or not only_b):
        return 100.0
    left, right = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    found = [ratio(left, right)]
    if both:
        found += [ratio(both, left), ratio(both, right)]
    return max(found)


def partial_token_ratio(a: str, b: str) -> float:
    both, only_a, only_b = _token_parts(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, token and partial ratios, the latter two scaled; 0 for an empty string."""
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    best = ratio(a, b)
    if long / short < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if long / short <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def _pairwise(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x or "", y or "") / 100 for x, y in zip(a, b)])

    return run


fuzzy_ratio = _pairwise(ratio)
fuzzy_token_set = _pairwise(token_set_ratio)
fuzzy_weighted = _pairwise(weighted_ratio)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)])


def fuzzy_threshold(a: Column, b: Column, base: float = 0.9, override: Column | None = None) -> Column:
    """Stricter for short names: under 4 characters 0.96 at least, under 8 plus 0.02; 1 for empty, 0.99 at most."""
    start = F.coalesce(override, F.lit(base)) if override is not None else F.lit(base)
    n = F.least(F.char_length(a), F.char_length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(0.99), F.when(n < 4, F.greatest(start, F.lit(0.96))).when(n < 8, start + 0.02).otherwise(start))
    )


def fuzzy_confidence(score: Column, threshold: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    gap = F.least(F.lit(0.4), F.abs(F.char_length(a) - F.char_length(b)) / longest)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - 0.25 * gap + F.greatest(F.lit(0.0), score - threshold)))
