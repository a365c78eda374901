"""Tail probabilities as Column expressions: Spark has no error function.

Each has a SQL form with the same steps, for oracles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: from here on the continued fraction takes over from the series
FAR = 2.0
TERMS = 120


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about 15 digits of itself."""
    steps = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(steps, F.lit(1.0), lambda t, k: 1 + t * 2 * x * x / (2 * k + 1))
    fraction = F.aggregate(steps, x.cast("double"), lambda t, k: x + k / 2 / t)
    near = 1 - 2 / math.sqrt(math.pi) * x * F.exp(-x * x) * series
    return F.when(x < FAR, near).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * fraction))


def erfc_sql(x: str) -> str:
    steps = f"list_transform(generate_series({TERMS}, 1, -1), lambda k: k::DOUBLE)"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, {steps}), lambda t, k: 1 + t * 2 * {x} * {x} / (2 * k + 1))"
    fraction = f"list_reduce(list_prepend({x}::DOUBLE, {steps}), lambda t, k: {x} + k / 2 / t)"
    return f"CASE WHEN {x} < {FAR} THEN 1 - 2 / sqrt(pi()) * {x} * exp(-{x} * {x}) * {series} ELSE exp(-{x} * {x}) / (sqrt(pi()) * {fraction}) END"


def chi2_tail(x: Column) -> Column:
    """P(X > x) of a chi-squared variable with one degree of freedom."""
    return erfc(F.sqrt(x / 2))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal variable."""
    return erfc(F.abs(z) / math.sqrt(2))


def fair_coin_tail(n: Column, least: Column) -> Column:
    """P(at least `least` heads in n fair coins), least > n / 2: the first term by logarithms, the others by their ratio to it."""
    n, least = n.cast("double"), least.cast("double")
    rest = F.sequence(F.lit(1), F.greatest(F.lit(1), (n - least).cast("int")))
    exists = n > least
    first = F.when(exists, F.aggregate(rest, F.lit(0.0), lambda a, i: a + F.ln((least + i) / i))).otherwise(0.0) - n * math.log(2)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a, i):
        term = a["term"] * (n - least - i + 1) / (least + i)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.exp(first) * F.when(exists, F.aggregate(rest, start, step, lambda a: a["sum"])).otherwise(1.0)
