"""Null and zero handling shared by every metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# A double is cut into multiples of 2**-13 and, of what is left, multiples of 2**-45.
_WHOLE, _REST = float(2**13), float(2**32)


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b * scale; NULL when b is zero or either side is NULL."""
    q = F.try_divide(a, b)
    return q if scale == 1.0 else q * F.lit(scale)


def ratio_or_zero(a: Column, b: Column, scale: float = 1.0) -> Column:
    return zero_if_null(ratio(a, b, scale))


def half_up(x: Column, digits: int) -> Column:
    """Round half up, treating anything within 0.00003 of the half as a half.

    A half of a cent has no exact double, and products round in their last digit. The tolerance keeps that
    from deciding which way a half goes, so engines that round in different places print the same figure.
    """
    factor = float(10**digits)
    return F.floor(x * F.lit(factor) + F.lit(0.50003)).cast("double") / F.lit(factor)


def exact_parts(x: Column, raising: bool = True) -> tuple[Column, Column]:
    """A double as two integers, in multiples of 2**-13 and of 2**-45; what lies below is left out.

    One that doesn't fit raises (under ANSI rules), or is NULL.
    """
    scaled = x * F.lit(_WHOLE)
    whole = scaled.cast("long") if raising else scaled.try_cast("long")
    return whole, ((scaled - whole) * F.lit(_REST)).cast("long")


def from_parts(whole: Column, rest: Column) -> Column:
    """The double of sums of exact parts."""
    return whole / F.lit(_WHOLE) + rest / F.lit(_WHOLE * _REST)


def exact_sum(x: Column, times: Column | None = None) -> Column:
    """Sum of doubles that is the same in whatever order, and over whatever partitions, they are added.

    Each is cut into two integers, whose sums are exact; what lies below 2**-45 is left out of each. A sum
    beyond 10**15, one of more than 2 * 10**9 rows and NaN raise (under ANSI rules) instead of going wrong.
    With `times` a row counts so many times, with the result that copies of it would have.
    """
    whole, rest = exact_parts(x)
    if times is not None:
        whole, rest = whole * times, rest * times
    return from_parts(F.sum(whole), F.sum(rest))


def sums(df: DataFrame, columns: dict[str, Column], times: Column | None = None) -> list[Column]:
    """Sums by name: exact ones of doubles, ordinary ones of whole numbers and decimals.

    With `times` a row counts so many times.
    """
    kinds = df.select(*[c.alias(name) for name, c in columns.items()]).schema
    floating = {f.name for f in kinds if isinstance(f.dataType, (DoubleType, FloatType))}

    def one(name: str, c: Column) -> Column:
        return exact_sum(c, times) if name in floating else F.sum(c if times is None else c * times)

    return [one(name, c).alias(name) for name, c in columns.items()]
