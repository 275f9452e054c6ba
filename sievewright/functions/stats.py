"""Closed-form statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054  # two-sided 95 %


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of the Wilson score interval; nulls for n = 0."""
    p, zz = k / n, F.lit(z * z)
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    ok = n > 0
    return F.struct(F.when(ok, F.greatest(F.lit(0.0), middle - half)).alias("low"), F.when(ok, F.least(F.lit(1.0), middle + half)).alias("high"))


WILSON_LOW = "greatest(0.0, ({k}/{n}::DOUBLE + 3.841458820694124/(2.0*{n}))/(1+3.841458820694124/{n}) - 1.959963984540054*sqrt(({k}/{n}::DOUBLE)*(1-{k}/{n}::DOUBLE)/{n} + 3.841458820694124/(4.0*{n}*{n}))/(1+3.841458820694124/{n}))"
WILSON_HIGH = "least(1.0, ({k}/{n}::DOUBLE + 3.841458820694124/(2.0*{n}))/(1+3.841458820694124/{n}) + 1.959963984540054*sqrt(({k}/{n}::DOUBLE)*(1-{k}/{n}::DOUBLE)/{n} + 3.841458820694124/(4.0*{n}*{n}))/(1+3.841458820694124/{n}))"


def kappa(observed: Column, expected: Column, undefined: Column | None = None) -> Column:
    """Cohen's kappa; where chance agreement is 1 the given value, else null."""
    return F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(undefined if undefined is not None else F.lit(None).cast("double"))
