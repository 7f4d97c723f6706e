"""Prices: effective price, rounding that halves agree on in any engine, exact sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gap between 1 and the next double; a fixed value of the money rounding.
EPSILON = 2.220446049250313e-16


def rounded(x: Column, places: int = 2) -> Column:
    """Half up after a nudge of EPSILON; null stays null."""
    unit = float(10**places)
    return F.floor((x + F.lit(EPSILON)) * F.lit(unit) + F.lit(0.5)).cast("double") / F.lit(unit)


def positive(x: Column) -> Column:
    """x if it is above 0 and finite, else null."""
    return F.when((x > 0) & (x < float("inf")), x)


def effective_price(retail: Column, promo: Column, strict: bool = True) -> Column:
    """The promotion's price if it is above 0 and below retail, else retail. strict: null where retail isn't above 0."""
    base = positive(retail) if strict else retail
    return F.when((promo > 0) & (promo < retail), promo).otherwise(base)


def exact_sum(x: Column) -> Column:
    """Sum of x to four places, so that the order of rows doesn't matter.

    Ten-thousandths are summed as whole numbers, upper and lower digits apart: both stay within a long for any table, and in generated code, which wide decimals don't.
    """
    units = F.floor(x * F.lit(10000.0) + F.lit(0.5))
    lower = units % F.lit(1_000_000)
    upper = F.sum(((units - lower) / F.lit(1_000_000)).cast("long"))
    return (upper.cast("double") * F.lit(1e6) + F.sum(lower).cast("double")) / F.lit(10000.0)


def exact_avg(x: Column) -> Column:
    return exact_sum(x) / F.count(x)


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole, rounded; 0 if whole is 0."""
    return F.when(whole > 0, rounded(part.cast("double") / whole, places)).otherwise(F.lit(0.0))
