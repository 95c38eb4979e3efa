"""Casts from text that give null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE = ["SI", "S", "VERDADERO", "TRUE", "1"]
FALSE = ["NO", "N", "FALSO", "FALSE", "0"]


def to_date(c: Column) -> Column:
    """Date from the first ten characters, only if they are year, month and day."""
    t = F.substring(F.trim(c), 1, 10)
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t).try_cast("date")


def to_date8(c: Column) -> Column:
    """Date from eight digits; 99991231 means none."""
    t = F.trim(c)
    iso = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    return F.when(t.rlike(r"^\d{8}$") & (t != "99991231"), iso).try_cast("date")


def to_timestamp(c: Column, pattern: str = "yyyy/MM/dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit(pattern)).cast("timestamp_ntz")


def to_decimal(c: Column, kind: str = "decimal(24,2)") -> Column:
    """Number without currency signs and thousands separators."""
    return F.regexp_replace(F.trim(c), "[,$]", "").try_cast(kind)


def to_long(c: Column) -> Column:
    """Whole number; decimals are rounded half up."""
    return F.round(F.trim(c).try_cast("decimal(38,6)")).try_cast("long")


def to_boolean(c: Column) -> Column:
    """Yes and no in Spanish and English; anything else is null."""
    t = F.upper(F.trim(c))
    return F.when(t.isin(TRUE), True).when(t.isin(FALSE), False)


def ratio(a: Column, b: Column) -> Column:
    """Double quotient; null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def displayed(c: Column, places: int = 4) -> Column:
    """Rounded for reports, nudged so that half-way cases don't depend on the last bit."""
    return F.round(c.cast("double") + F.lit(1e-7), places)
