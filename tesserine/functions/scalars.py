"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date(text: str) -> Column:
    """A date literal, yyyy-MM-dd."""
    return F.to_date(F.lit(text), "yyyy-MM-dd")


def packed_date(d: Column) -> Column:
    """A date as one whole number that keeps the order: (year << 9) + (month << 5) + day."""
    return F.shiftleft(F.year(d), 9) + F.shiftleft(F.month(d), 5) + F.dayofmonth(d)


def if_else(condition: Column, yes: object, no: object) -> Column:
    return F.when(condition, yes).otherwise(no)


def char_at(s: Column, i: int = 0) -> Column:
    return F.substring(s, i + 1, 1)


def int_divide(a: Column, b: Column) -> Column:
    """Whole division, toward zero."""
    return F.call_function("div", a, b)


def ip_to_int(ip: Column) -> Column:
    """A dotted address as a whole number: each part takes eight bits."""
    part = [F.split_part(ip, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
    return F.shiftleft(part[0], 24) + F.shiftleft(part[1], 16) + F.shiftleft(part[2], 8) + part[3]


def parse_boolean(s: Column) -> Column:
    """True for exactly "true"; everything else is false."""
    return F.coalesce(s == F.lit("true"), F.lit(False))


def sum_root_deviation(total_square: Column, n: Column) -> Column:
    """The square root of a sum of squared deviations, divided by the number (outside the root)."""
    return F.sqrt(total_square) / n
