"""Rounding that agrees with IEEE arithmetic rather than with the printed digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"


_SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two halves whose products are exact


def round_even(col: Column, digits: int) -> Column:
    """The decimal nearest to the stored value, ties to even: 0.00015 gives 0.0001 and 0.00025
    gives 0.0003, since the first is stored a little low and the second a little high.

    ``F.round`` looks at the shortest decimal text instead, and scaling alone rounds before it
    compares; here the rounding error of the scaled value decides what looks like a tie.
    """
    scale = float(10**digits)
    big = col * _SPLIT
    head = big - (big - col)
    scaled = col * scale
    error = (head * scale - scaled) + (col - head) * scale
    below = F.floor(scaled).cast("double")
    over_half = (scaled - below - 0.5) + error
    up = (over_half > 0) | ((over_half == 0) & (below % 2 != 0))
    rounded = (below + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.abs(scaled) < 2.0**52, rounded).otherwise(col)


def round_scaled(col: Column, digits: int) -> Column:
    """Scale, round half to even, scale back, as array libraries round."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def exact_sum(col: Column) -> Column:
    """Sum of amounts in decimal, so that it does not depend on how rows are partitioned."""
    return F.sum(col.cast(MONEY))
