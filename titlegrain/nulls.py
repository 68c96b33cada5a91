"""One meaning of "missing" for the whole engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that stand for a missing value.
SENTINELS = ("", "-", "*", "not detected", "none", "null")


def missing(col: Column) -> Column:
    """True for NULL and for every sentinel text (blanks around it and case ignored)."""
    return col.isNull() | F.lower(F.trim(col)).isin(*SENTINELS)


def nullify(col: Column) -> Column:
    """The value, or NULL where it is missing."""
    return F.when(~missing(col), col)


def nullify_amount(col: Column) -> Column:
    """As ``nullify``; for money and document references ``0`` is missing as well."""
    return F.when(~missing(col) & (F.trim(col) != "0"), col)
