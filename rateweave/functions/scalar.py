"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_interp(x: Column, x1: float, x2: float, y1: float, y2: float) -> Column:
    """Map ``x`` from the range [x1, x2] onto [y1, y2]."""
    return F.lit(float(y1)) + (x - F.lit(float(x1))) * F.lit((float(y2) - float(y1)) / (float(x2) - float(x1)))


def clip(x: Column, lo: float, hi: float) -> Column:
    """``x`` held within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def non_empty(m: Column) -> Column:
    """A map or array that is there and holds something."""
    return m.isNotNull() & (F.size(m) > 0)


def map_get(m: Column, key: str) -> Column:
    """Value under ``key``; null for a null map or a missing key."""
    return F.try_element_at(m, F.lit(key))


def binary_flag(value: Column) -> Column:
    """1 for a true value, else 0. JSON booleans and strings both arrive as text."""
    return F.when(F.lower(value) == "true", F.lit(1)).otherwise(F.lit(0))


def one_hot(value: Column, answer: str, known: Column) -> Column:
    """1 where ``value`` is ``answer``; a missing value counts as ``n/a`` if the row is known."""
    present = F.when(known, F.coalesce(value, F.lit("n/a")))
    return F.when(present == answer, F.lit(1)).otherwise(F.lit(0))


def int_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def date_code(value: Column) -> Column:
    """``YYYY-MM-DD`` as the integer YYYYMMDD."""
    return F.replace(value, F.lit("-"), F.lit("")).try_cast("int")


def clock(text: Column) -> Column:
    """``H:M`` as the decimal number H.M, so 11:30 is 11.30."""
    return F.replace(text, F.lit(":"), F.lit(".")).try_cast("double")


def opening_times(hours: Column) -> Column:
    return F.transform(F.map_values(hours), lambda span: clock(F.split_part(span, F.lit("-"), F.lit(1))))


def closing_times(hours: Column) -> Column:
    return F.transform(F.map_values(hours), lambda span: clock(F.split_part(span, F.lit("-"), F.lit(2))))


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def list_length(text: Column) -> Column:
    """Entries of a ``a, b, c`` list; a missing, empty or ``None`` list has none."""
    return F.when(text.isNull() | text.isin("", "None"), F.lit(0)).otherwise(F.size(F.split(text, ", ")))


def amplify(weight: Column) -> Column:
    """|w| to the power 2.5, from products and a square root so that it rounds alike everywhere."""
    a = F.abs(weight)
    return a * a * F.sqrt(a)


def reflect_rating(rating: Column, weight: Column) -> Column:
    """For a negative weight the rating is mirrored within 1..5."""
    return F.when(weight < 0, linear_interp(-rating, -5, -1, 1, 5)).otherwise(rating)
