"""Exact tests as Column expressions."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import let

SHIFT = 8


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + SHIFT, brought back by the recurrence; good to about 1e-13 of the result."""

    def at(z: Column) -> Column:
        w = 1 / (z * z)
        series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z
        return (z - 0.5) * F.log(z) - z + 0.5 * log(2 * pi) + series

    rising = x.cast("double")
    for i in range(1, SHIFT):
        rising = rising * (x + i)
    return let(x.cast("double") + SHIFT, at) - F.log(rising)


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of n fair coins, for 0 <= k <= n / 2.

    The largest term, and the others by their ratios (the series of the
    incomplete beta function): from one term to the next by (k - i) / (n - k + 1 + i).
    Terms beyond 60 + 5 sqrt(n) are under 1e-20 of the sum.
    """
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * log(2))
    most = F.least(k, F.ceil(60 + 5 * F.sqrt(n))).cast("int")
    steps = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        return let(s["term"] * (k - i) / (n - k + 1 + i), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))

    return first * F.aggregate(steps, start, add, lambda s: s["sum"])


def mcnemar_p(lost: Column, gained: Column) -> Column:
    """Exact two-sided p-value of discordant counts: twice the smaller tail, at most 1."""
    n = lost + gained
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.least(lost, gained), n)))


def mcnemar_z(lost: Column, gained: Column) -> Column:
    """The difference in standard errors: positive if more was gained; 0 without discordant items."""
    n = lost + gained
    return F.when(n == 0, F.lit(0.0)).otherwise((gained - lost) / F.sqrt(n))
