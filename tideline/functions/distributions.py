"""Tails of the distributions that tests need, as columns: Student's t, F, chi-square, normal, and Kendall's exact count.

Regularised incomplete beta and gamma functions by continued fractions and series, folded over a number of steps that
grows with the square root of the larger parameter, as their convergence does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import bind

TINY = 1e-300
#: Log-gamma is summed this far up, where Stirling's series has its last digits, and brought back.
UP = 12


def _held(body, **values: Column) -> Column:
    """body of the values, each computed once a row."""
    return bind(F.struct(*(v.cast("double").alias(k) for k, v in values.items())), lambda s: body(*(s[k] for k in values)))


def _not_zero(x: Column) -> Column:
    return F.when(x == 0, TINY).otherwise(x)


def log_gamma(z: Column) -> Column:
    """Of z above 0."""
    product = z
    for k in range(1, UP):
        product = product * (z + k)
    u = z + UP
    series = 1 / (12 * u) - 1 / (360 * u * u * u) + 1 / (1260 * u * u * u * u * u)
    return (u - 0.5) * F.log(u) - u + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def steps(*sizes: Column) -> Column:
    """1, 2, ... as far as fractions and series need to go for such parameters."""
    most = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return F.sequence(F.lit(1), (100 + 10 * F.ceil(F.sqrt(most))).cast("int"))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def half(m: Column, first: Column) -> Column:
        return F.when(first, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    def step(s: Column, i: Column) -> Column:
        t = half(F.floor((i + 1) / 2).cast("double"), i % 2 == 1)
        return bind(F.struct(_not_zero(1 + t / s.c).alias("c"), (1 / _not_zero(1 + t * s.d)).alias("d"), s.out.alias("out")), lambda n: F.struct(n.c.alias("c"), n.d.alias("d"), (n.out * n.c * n.d).alias("out")))

    d = 1 / _not_zero(1 - (a + b) * x / (a + 1))
    both = F.transform(F.sequence(F.lit(1), 2 * F.size(steps(a, b))), lambda i: i)
    return F.aggregate(both, F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("out")), step, lambda s: s.out)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""

    def side(a: Column, b: Column, x: Column, swapped: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        part = front * _beta_fraction(a, b, x) / a
        return F.when(swapped > 0, 1 - part).otherwise(part)

    def share(a: Column, b: Column, x: Column) -> Column:
        swap = x >= (a + 1) / (a + b + 2)
        pick = lambda p, q: F.when(swap, q).otherwise(p)
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(_held(side, a=pick(a, b), b=pick(b, a), x=pick(x, 1 - x), swapped=swap.cast("int")))

    return _held(share, a=a, b=b, x=x)


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function."""

    def tail(a: Column, x: Column) -> Column:
        front = F.exp(a * F.log(x) - x - log_gamma(a))

        def term(s: Column, i: Column) -> Column:
            return bind(F.struct((s.term * x / (a + i)).alias("term"), s.total.alias("total")), lambda n: F.struct(n.term.alias("term"), (n.total + n.term).alias("total")))

        series = F.aggregate(steps(a), F.struct((1 / a).alias("term"), (1 / a).alias("total")), term, lambda s: s.total)

        def step(s: Column, i: Column) -> Column:
            t, b = -i * (i - a), x + 1 - a + 2 * i
            return bind(F.struct(_not_zero(b + t / s.c).alias("c"), (1 / _not_zero(t * s.d + b)).alias("d"), s.out.alias("out")), lambda n: F.struct(n.c.alias("c"), n.d.alias("d"), (n.out * n.c * n.d).alias("out")))

        d = 1 / _not_zero(x + 1 - a)
        fraction = F.aggregate(steps(a), F.struct(F.lit(1 / TINY).alias("c"), d.alias("d"), d.alias("out")), step, lambda s: s.out)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return _held(tail, a=a, x=x)


def t_two_sided(t: Column, df: Column) -> Column:
    share = _held(lambda t, df: beta_share(df / 2, F.lit(0.5), df / (df + t * t)), t=t, df=df)
    return F.when(t.isNull() | (df <= 0), F.lit(None)).when(F.abs(t) == math.inf, 0.0).otherwise(share)


def f_tail(f: Column, a: Column, b: Column) -> Column:
    share = _held(lambda f, a, b: beta_share(b / 2, a / 2, b / (a * f + b)), f=f, a=a, b=b)
    return F.when(f.isNull() | (a <= 0) | (b <= 0), F.lit(None)).when(f == math.inf, 0.0).otherwise(share)


def chi2_tail(x: Column, df: Column) -> Column:
    return F.when(x.isNull() | (df <= 0), F.lit(None)).otherwise(gamma_tail(df / 2, x / 2))


def normal_two_sided(z: Column) -> Column:
    return F.when(z.isNotNull(), gamma_tail(F.lit(0.5), z * z / 2))


def kendall_two_sided(discordant: Column, n: Column) -> Column:
    """Exact, for rankings without ties of two items or more: how many permutations of n have so few or so many inversions."""

    def longer(counts: Column, k: Column) -> Column:
        def at(i: Column) -> Column:
            first = F.greatest(i - k + 2, F.lit(1))
            return F.aggregate(F.slice(counts, first, F.least(i + 1, F.size(counts)) - first + 1), F.lit(0.0), lambda s, c: s + c)

        return F.transform(F.sequence(F.lit(0), F.size(counts) + k - 2), at)

    most = n * (n - 1) / 2
    less = F.least(discordant, most - discordant).cast("int")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    share = bind(F.aggregate(F.sequence(F.lit(2), n.cast("int")), F.array(F.lit(1.0)), longer), lambda c: F.least(2 * total(F.slice(c, F.lit(1), less + 1)) / total(c), F.lit(1.0)))
    return F.when(2 * less < most, share).otherwise(1.0)
