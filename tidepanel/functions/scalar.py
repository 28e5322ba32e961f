"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

MONTHS_PER_YEAR = 12
DAYS_PER_YEAR = 252

# Coefficients of the Abramowitz-Stegun 7.1.26 error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, null where ``den`` is zero (ANSI division would raise)."""
    return num / F.nullif(den, F.lit(0.0))


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def clip(x: Column, lo, hi) -> Column:
    return F.greatest(F.least(x, hi if isinstance(hi, Column) else F.lit(hi)), lo if isinstance(lo, Column) else F.lit(lo))


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, error below 1.5e-7."""
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)


def annual_sharpe(mean: Column, std: Column, n: Column) -> Column:
    ratio = safe_div(mean, std) * F.lit(math.sqrt(MONTHS_PER_YEAR))
    return F.when(n >= 2, zero_if_null(ratio)).otherwise(F.lit(0.0))


def percent_text(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", x * 100)).otherwise("n/a")


def fixed_text(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise("n/a")


def rounded(df, digits: int = 8, **per_column: int):
    """Round every double column, so that summation order cannot show."""
    return df.select(*[
        F.round(c, per_column.get(c, digits)).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ])
