"""Number parsing and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The special floating point numbers the line formats allow.
SPECIAL_DOUBLES = ["NaN", "+NaN", "-NaN", "Infinity", "+Infinity", "-Infinity"]
SPECIAL_DOUBLES_ANY_CASE = r"(?i)^[+-]?(nan|inf|infinity)\z"


def to_long(text: Column) -> Column:
    """Text as bigint, or null; unlike a bare cast, spaces around it are not allowed.

    The cast alone only forgives what surrounds a number, so looking at the
    first and last character is enough, and far cheaper than a pattern.
    """
    starts_bare = (text >= F.lit("+")) & (text < F.lit(":"))  # "+" to "9" in ASCII
    bare = starts_bare & F.substring(text, -1, 1).between("0", "9")
    return F.when(bare, text.try_cast("bigint"))


def to_double(text: Column) -> Column:
    """Text as double, or null; special values only in their exact spelling."""
    number, trimmed = text.try_cast("double"), F.trim(text)
    ordinary = F.abs(number) < F.lit(float("inf"))
    misspelt = trimmed.rlike(SPECIAL_DOUBLES_ANY_CASE) & ~trimmed.isin(SPECIAL_DOUBLES)
    return F.when(ordinary | ~misspelt, number)


def strict_long(text: Column) -> Column:
    """Text as bigint; the job fails on anything else."""
    number = to_long(text)
    message = F.concat(F.lit("not a number: "), F.coalesce(text, F.lit("null")))
    return F.when(number.isNotNull(), number).otherwise(F.raise_error(message).cast("bigint"))


def divisible_by(number: Column, divisor: int) -> Column:
    """True where ``number`` is a multiple of ``divisor``; sign does not matter."""
    return number % F.lit(divisor) == 0
