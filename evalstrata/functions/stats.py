"""Interval and test statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(_d(part), _d(whole)), F.lit(0.0))


def wilson(successes: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's score interval, clipped to [0, 1]; (0, 0) where n <= 0."""
    s, n = _d(successes), _d(n)
    p, z2 = F.try_divide(s, n), F.lit(z * z)
    denominator = F.lit(1.0) + F.try_divide(z2, n)
    centre = (p + F.try_divide(z2, 2 * n)) / denominator
    radius = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z2, 4 * n * n)) / denominator
    low, high = F.greatest(F.lit(0.0), centre - radius), F.least(F.lit(1.0), centre + radius)
    return F.when(n > 0, low).otherwise(F.lit(0.0)), F.when(n > 0, high).otherwise(F.lit(0.0))


def paired_difference_interval(a_only: Column | str, b_only: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Interval of the difference of two paired proportions, clipped; (-1, 1) where n <= 1."""
    b, c, n = _d(a_only), _d(b_only), _d(n)
    delta = F.try_divide(b - c, n)
    spread = F.sqrt(F.greatest(F.lit(0.0), b + c - F.coalesce(F.try_divide((b - c) * (b - c), n), F.lit(0.0))) + 1)
    error = F.lit(z) * F.try_divide(spread, n)
    low, high = F.greatest(F.lit(-1.0), delta - error), F.least(F.lit(1.0), delta + error)
    return F.when(n > 1, low).otherwise(F.lit(-1.0)), F.when(n > 1, high).otherwise(F.lit(1.0))


def exact_mcnemar_p(b: Column | str, c: Column | str) -> Column:
    """Two-sided exact McNemar p: min(1, 2 sum_{k<=min} C(n, k) / 2**n), 1 where n is 0.

    Terms are summed relative to the last one, C(n, m), going down from k = m,
    so nothing under- or overflows.  They fall off at least as fast as a normal
    density, so 5 sqrt(n) + 50 of them leave out less than 1e-18 of the sum.  ln
    C(n, m) is a sum of logarithms for small m, Stirling's series for large ones.
    """
    b, c = (F.col(x) if isinstance(x, str) else x for x in (b, c))
    n, m = (b + c).cast("long"), F.least(b, c).cast("long")
    few = F.least(m, F.lit(1000)).cast("int")
    steps = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    log_small = F.aggregate(steps(few), F.lit(0.0), lambda a, k: a + F.log((n - m + k).cast("double")) - F.log(k.cast("double")))

    def log_factorial(x: Column) -> Column:
        x = F.greatest(x.cast("double"), F.lit(1.0))
        return x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)

    log_last = F.when(m <= 1000, log_small).otherwise(log_factorial(n) - log_factorial(m) - log_factorial(n - m))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(a: Column, k: Column) -> Column:  # C(n, j-1) = C(n, j) * j / (n - j + 1), j = m - k + 1
        term = a["term"] * (m - k + 1).cast("double") / (n - m + k).cast("double")
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    enough = F.least(m, F.ceil(5 * F.sqrt(n.cast("double")) + 50)).cast("int")
    total = F.aggregate(steps(enough), start, down, lambda a: a["total"])
    p = F.exp(log_last + F.log(total) + (1.0 - n.cast("double")) * F.log(F.lit(2.0)))
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def pairs(n: Column) -> Column:
    """n over 2, as a whole number."""
    return (n * (n - 1) / 2).cast("long")


def majority(yes: Column | str, no: Column | str) -> Column:
    """The answer with more votes, null without votes or on a tie."""
    y, n = (F.col(x) if isinstance(x, str) else x for x in (yes, no))
    return F.when(y > n, F.lit("yes")).when(n > y, F.lit("no"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; 64 where one is empty or the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bits = F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), bits).otherwise(F.lit(64)).cast("int")


def interpret_agreement(x: Column | str) -> Column:
    """The usual bands of a chance-corrected coefficient, null for null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), None).when(x < 0, "worse than chance").when(x < 0.21, "slight").when(x < 0.41, "fair").when(x < 0.61, "moderate").when(x < 0.81, "substantial").otherwise("almost perfect")


def fragility_verdict(score: Column | str) -> Column:
    x = F.col(score) if isinstance(score, str) else score
    return F.when(x < 3, "stable").when(x < 12, "sensitive").when(x < 30, "fragile").otherwise("very fragile")


def format_bytes(n: Column | str) -> Column:
    """1024-unit text: bytes whole, larger units with one decimal (ties to even), null for null."""
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    out = F.when(n.isNull(), None).when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**i, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1)))
