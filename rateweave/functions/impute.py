"""Replacement of missing values by a per-column rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Where a feature comes from and what stands in when it is missing.

    ``default`` names a constant (see ``features.constants``), is a number, or is None to
    leave the gap. With ``zero_is_missing`` a zero is a gap too.
    """

    source: str
    default: str | float | None = 0.0
    zero_is_missing: bool = False


def impute(value: Column, default: Column | float | None, zero_is_missing: bool = False) -> Column:
    value = value.cast("double")
    if zero_is_missing:
        value = F.nullif(value, F.lit(0.0))
    if default is None:
        return value
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(float(default)))
