"""Rounding and guards that give the same value whatever engine wrote the column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(amount: Column) -> Column:
    """Exact DECIMAL amount rounded half up to cents."""
    return F.round(amount, 2)


def hundredth(amount_rate: Column) -> Column:
    """One percent of a DECIMAL product or sum with up to five decimals.

    DECIMAL(34,5) times 0.01 still fits 38 digits, so nothing is rounded before
    the final step; dividing by 100.0 would not be exact.
    """
    return amount_rate.cast("decimal(34,5)") * F.lit("0.01").cast("decimal(2,2)")


def half_up(value: Column, digits: int = 0) -> Column:
    """DOUBLE rounded half up; the same in every engine, unlike ROUND on DOUBLE."""
    scale = F.lit(float(10**digits))
    return F.floor(value.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def mean_of(total: Column, n: Column, digits: int = 2) -> Column:
    """Rounded average from an exact sum and a count; NULL when nothing was counted."""
    return half_up(total.cast("double") / F.nullif(n, F.lit(0)), digits)


def no_null(column: Column, default: object = 0) -> Column:
    return F.coalesce(column, F.lit(default))
