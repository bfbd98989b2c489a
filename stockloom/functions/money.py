"""Exact money arithmetic in whole cents.

Decimal averages keep too few digits and double averages are inexact, so averages and
ratios are taken over integers and rounded half-up once.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Whole cents of a decimal amount with two decimals.

    The product stays within 18 digits for up to 14-digit amounts, which Spark keeps in a
    machine word.
    """
    return (amount * 100).cast("bigint")


def cents_of_double(amount: Column) -> Column:
    """Whole cents of a double that stands for an amount with two decimals."""
    return F.rint(amount * 100).cast("bigint")


def from_cents(value: Column, precision: int = 12) -> Column:
    """Decimal amount with two decimals from whole cents."""
    return (value.cast(f"decimal({precision},0)") * F.lit(Decimal("0.01"))).cast(f"decimal({precision},2)")


def half_up(numerator: Column, denominator: Column) -> Column:
    """Integer quotient rounded half-up; both sides non-negative, NULL for a zero divisor."""
    safe = F.when(denominator != 0, denominator)
    return F.call_function("div", numerator * 2 + safe, safe * 2)


def round_half_up(numerator: Column, denominator: Column) -> Column:
    """As :func:`half_up`, rounding away from zero for a negative numerator."""
    return F.when(numerator < 0, -half_up(-numerator, denominator)).otherwise(half_up(numerator, denominator))


def hundredths_mean(total: Column, count: Column) -> Column:
    """Unrounded mean, as a double, of values summed in hundredths."""
    return total.cast("double") / (count * F.lit(100)).cast("double")
