"""Column functions: parsing, dates, clamps, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_datetime(col: Column, formats: Sequence[str] = ()) -> Column:
    """First format that parses, else Spark's default rule; bad values become null."""
    tries = [F.try_to_timestamp(col, F.lit(f)) for f in formats]
    return F.coalesce(*tries, F.try_to_timestamp(col))


def parse_number(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS DOUBLE)")


def month_of(col: Column) -> Column:
    return F.trunc(col, "MM")


def months_apart(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two dates' months."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def monday_zero(col: Column) -> Column:
    return F.weekday(col)


def _clamped(number: Column, low, high, default) -> Column:
    return F.when(number.isNull(), F.lit(default)).otherwise(F.least(F.greatest(number, F.lit(low)), F.lit(high)))


def clamp_confidence(col: Column) -> Column:
    """[0, 1]; 0.5 for a value that is no number."""
    return _clamped(col.try_cast("double"), 0.0, 1.0, 0.5)


def clamp_priority(col: Column, highest: int = 10) -> Column:
    """[1, highest]; 5 for a value that is no whole number."""
    return _clamped(col.try_cast("int"), 1, highest, 5)


def corr_strength(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size >= 0.8, "very_strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak").otherwise("negligible")
    )
