"""Column expressions: tolerant casts, guarded arithmetic, text and geography."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.schema import DEFAULTS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text to double; what cannot be read is NULL."""
    return col(c).try_cast("double")


def clip(c: str | Column, low: Column, high: Column) -> Column:
    """Clip that keeps NULL (least and greatest alone would turn it into a bound)."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), low), high))


def ratio(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """a / b, or ``otherwise`` (NULL by default) where b is zero."""
    return F.when(b != 0, a / b).otherwise(otherwise)


def deficit(c: str | Column) -> Column:
    """The size of a negative value, 0 for others, NULL for NULL."""
    return F.when(col(c) < 0, -col(c)).when(col(c).isNotNull(), F.lit(0.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    )
    return 2 * DEFAULTS.earth_radius_km * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def code_key(c: str | Column) -> Column:
    """Trimmed, upper-case code."""
    return F.upper(F.trim(col(c)))


def zero_padded(c: str | Column, width: int = 3) -> Column:
    """At least ``width`` characters with zeros in front; longer codes stay as they are."""
    text = col(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def leading_year(c: str | Column) -> Column:
    """The year that a text such as ``2015-Q4`` begins with."""
    return F.substring(col(c), 1, 4).try_cast("int")


def end_year(c: str | Column) -> Column:
    """The last year of a text such as ``2020-2022``, or its only one."""
    parts = F.split(col(c), "-")
    return F.element_at(parts, -1).try_cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
