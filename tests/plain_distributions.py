"""Tails of distributions in plain Python, against which the columns are held."""

from __future__ import annotations

import math
from functools import cache

TINY = 1e-300


def _fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or TINY)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or TINY)
            c = 1.0 + step / c or TINY
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or TINY)
        c = b + step / c or TINY
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float | None, df: float) -> float | None:
    if t is None or df <= 0:
        return None
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_tail(f: float | None, a: float, b: float) -> float | None:
    if f is None or a <= 0 or b <= 0:
        return None
    return 1 - beta_share(a / 2, b / 2, a * f / (a * f + b)) if math.isfinite(f) else 0.0


def chi2_tail(x: float | None, df: float) -> float | None:
    return None if x is None or df <= 0 else gamma_tail(df / 2, x / 2)


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


@cache
def _inversions(n: int) -> tuple[int, ...]:
    """Permutations of n by their number of inversions."""
    counts = [1]
    for k in range(2, n + 1):
        counts = [sum(counts[max(0, i - k + 1) : i + 1]) for i in range(len(counts) + k - 1)]
    return tuple(counts)


def kendall_two_sided(discordant: int, n: int) -> float:
    """Exact, for rankings without ties."""
    counts, most = _inversions(n), n * (n - 1) // 2
    less = min(discordant, most - discordant)
    return min(1.0, 2 * sum(counts[: less + 1]) / math.factorial(n)) if 2 * less < most else 1.0
