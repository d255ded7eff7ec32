"""Sums and means of doubles that do not depend on the order of the rows.

A double is cut into five signed digits to the base 2**36, the last of which counts units of 2**-126. The digits are
integers, so their sums are exact and combine before a shuffle in any order; the total is put together once per group.
That keeps all bits of values from 1e-22 up to 2**54, for groups of up to 2**27 rows (beyond, the sum of longs
raises an error). Values of 2**54 and more, infinite ones and NaN are added as plain doubles.

The mean divides digit by digit with remainders, so the mean of equal values is that value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 2.0**36
UNITS = tuple(2.0**power for power in (18, -18, -54, -90, -126))
LARGEST = 2.0**54


def _split(value: Column) -> tuple[Column, list[Column], Column]:
    """The value as a double, the sums of its digits, and the plain sum of what cannot be cut (null if there is none)."""
    value = value.cast("double")
    inside = F.abs(value) < LARGEST
    whole = [F.rint(value * F.lit(1.0 / unit)) for unit in UNITS]
    digits = [whole[0], *[low - high * F.lit(BASE) for high, low in zip(whole, whole[1:])]]
    sums = [F.sum(F.when(inside, digit).cast("long")) for digit in digits]
    return value, sums, F.sum(F.when(~inside, value))


def _together(digits: list[Column]) -> Column:
    total = digits[0].cast("double") * F.lit(UNITS[0])
    for digit, unit in zip(digits[1:], UNITS[1:]):
        total = total + digit.cast("double") * F.lit(unit)
    return total


def _with_plain(exact: Column, sums: list[Column], plain: Column, divisor: Column) -> Column:
    return F.when(plain.isNull(), exact).otherwise((F.coalesce(_together(sums), F.lit(0.0)) + plain) / divisor)


def exact_sum(value: Column | str) -> Column:
    """An aggregate: the sum of the values that are not null."""
    _, sums, plain = _split(F.col(value) if isinstance(value, str) else value)
    return _with_plain(_together(sums), sums, plain, F.lit(1.0))


def exact_avg(value: Column | str) -> Column:
    """An aggregate: the mean of the values that are not null."""
    value, sums, plain = _split(F.col(value) if isinstance(value, str) else value)
    rows = F.nullif(F.count(value), F.lit(0))
    mean = _together([F.call_function("div", total, rows) for total in sums])
    mean = mean + _together([(total % rows) / rows for total in sums])
    return _with_plain(mean, sums, plain, rows)


def sorted_deviation(values: Column, mean: Column) -> Column:
    """The sample standard deviation of an array of doubles, summed in ascending order; null for fewer than two."""
    squares = F.aggregate(F.array_sort(values), F.lit(0.0), lambda total, v: total + (v - mean) * (v - mean))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))
