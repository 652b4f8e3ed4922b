"""Tests of paired differences, computed on the driver from a few sums."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, comb, erfc, sqrt


def wilcoxon_p(n: int, w_plus: float, w_minus: float, ties: float) -> float | None:
    """Two-sided p of the signed-rank test: normal approximation, tie-corrected, without continuity correction; None without differences.

    n differing pairs, sums of positive and negative ranks, ties = sum of t^3 - t.
    """
    if n == 0:
        return None
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (min(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(variance)
    return erfc(abs(z) / sqrt(2))


def sign_test_p(positive: int, negative: int) -> float:
    """Two-sided binomial test of as many positive as negative differences."""
    n, k = positive + negative, min(positive, negative)
    return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def nearest_rank(values: Sequence[float], share: float) -> float:
    return sorted(values)[max(1, ceil(share * len(values) - 1e-12)) - 1]
