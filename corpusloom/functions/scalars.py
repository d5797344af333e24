"""Date and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: days from 1790-01-08 to 1970-01-01, accepted date spellings
DAY_ZERO_OFFSET = 65736
MDY_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "M-d-yyyy", "MMMM d yyyy")
# -----------------------------------------------------------------------------


def mdy(text: Column | str) -> Column:
    """Month-day-year text to DATE; null when no accepted spelling fits."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, fmt) for fmt in MDY_FORMATS])


def date_number(date: Column | str) -> Column:
    """Days since 1790-01-08."""
    return F.unix_date(date) + F.lit(DAY_ZERO_OFFSET)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def log_factorial(n: Column) -> Column:
    """ln(n!) for a whole number n >= 0."""
    steps = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.ln(k.cast("double")))
