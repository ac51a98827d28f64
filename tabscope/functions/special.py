"""Distribution functions of single numbers, for p-values on the driver."""

from __future__ import annotations

from fractions import Fraction
from math import comb, erfc, exp, inf, isfinite, isnan, lcm, lgamma, log, nan, sqrt

TINY = 1e-300


def fraction(step, limit: int = 10_000) -> float:
    """A continued fraction b0 + a1 / (b1 + a2 / ...) by Lentz; step(k) gives (a, b)."""
    value = step(0)[1] or TINY
    c, d = value, 0.0
    for k in range(1, limit):
        a, b = step(k)
        d = 1 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return value


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if isnan(x):
        return nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)

    def step(k: int) -> tuple[float, float]:
        if k <= 1:
            return 1.0, float(k)
        m, odd = divmod(k - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    return front * fraction(step)


def gamma_rest(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if isnan(x):
        return nan
    if x <= 0:
        return 1.0
    if x == inf:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    return front / fraction(lambda k: (1.0, x + 1 - a) if k == 0 else (-k * (k - a), x + 2 * k + 1 - a))


def t_two_sided(t: float, df: float) -> float:
    if isnan(t) or isnan(df):
        return nan
    return 0.0 if not isfinite(t) else beta_part(df / 2, 0.5, df / (df + t * t))


def f_above(f: float, df1: float, df2: float) -> float:
    if isnan(f):
        return nan
    return 0.0 if f == inf else beta_part(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_above(x: float, df: float) -> float:
    return gamma_rest(df / 2, x / 2)


def normal_above(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def bounded_partitions(u: int, parts: int, most: int) -> int:
    """How many multisets of ``parts`` numbers from 0 to ``most`` have a sum of ``u`` at most.

    They are counted by the product of (1 - q^(most+k)) / (1 - q^k) over k up to ``parts``,
    and 1 / (1 - q) for the running sum.  All denominators divide 1 - q^m for their common
    multiple m, so what stands over its power is one polynomial, of a degree that only
    ``parts`` decides, and each coefficient of the quotient a few binomials.  The factors
    above give few terms, each a shift by a multiple of ``most``.  Exact integers; the memory
    is the polynomial (7000 terms for eight parts), however large ``u`` and ``most`` are.
    """
    m = lcm(*range(1, parts + 1))
    over = [1]
    for a in (1, *range(1, parts + 1)):  # times (1 - q^m) / (1 - q^a)
        longer = over + [0] * (m - a)
        for i in range(a, len(longer)):
            longer[i] += longer[i - a]
        over = [w - (longer[i - m] if i >= m else 0) for i, w in enumerate(longer)]
    shifts = {(0, 0): 1}
    for k in range(1, parts + 1):
        for (count, total), sign in list(shifts.items()):
            at = (count + 1, total + k)
            shifts[at] = shifts.get(at, 0) - sign
    out = 0
    for (count, total), sign in shifts.items():
        left = u - count * most - total
        if left >= 0:
            out += sign * sum(over[j] * comb((left - j) // m + parts, parts) for j in range(left % m, min(len(over) - 1, left) + 1, m))
    return out


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided chance of a U at least as far from its mean, without ties; the smaller group decides the work."""
    few, many = min(n1, n2), max(n1, n2)
    low = int(min(u, n1 * n2 - u))
    return min(1.0, float(Fraction(2 * bounded_partitions(low, few, many), comb(n1 + n2, few))))
