"""String similarity by longest common subsequence, in Arrow batches: Spark has edit distance but no Indel ratio."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity: 200 * LCS / (len(a) + len(b)); 100 for two empty strings."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words alone and with either side's others; 100 where one side adds nothing."""
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    pairs = [(one, two)] + ([(both, one), (both, two)] if both else [])
    return max(ratio(p, q) for p, q in pairs) if x or y else 0.0


def pair_score(a: str, b: str) -> float:
    """The better of the ratio of sorted words and that of the strings without spaces, to one decimal."""
    return round(max(token_sort_ratio(a, b), ratio(a.replace(" ", ""), b.replace(" ", ""))), 1)


def _udf(f):
    @F.pandas_udf(DoubleType())
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score


indel_ratio, token_set, best_pair_score = _udf(ratio), _udf(token_set_ratio), _udf(pair_score)
