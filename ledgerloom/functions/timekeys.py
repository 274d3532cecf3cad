"""Store-local period keys of UTC instants, and calendar helpers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("date", "week", "month", "year")
#: As `tz` of a report: every store in its own zone. Rows then carry the zone of their store and, as UTC
#: instants, the bounds of the report's range there (`plans.tables.in_own_zones` adds them).
OWN_ZONE = "own"
ZONE, ZONE_LOW, ZONE_HIGH = "time_zone", "zone_low", "zone_high"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _day(value: str | date) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def store_time(ts: str | Column, tz: str | Column) -> Column:
    """Wall-clock time in the store's zone. `tz` is a zone name, a column holding one per row, or OWN_ZONE."""
    own = isinstance(tz, str) and tz == OWN_ZONE
    return F.from_utc_timestamp(_col(ts), F.col(ZONE) if own else tz)


def zone_bounds(tz: Column, start: str | date, end: str | date) -> dict[str, Column]:
    """UTC instants at which the local range [start, end] of a zone begins and has ended."""
    midnights = {ZONE_LOW: _day(start), ZONE_HIGH: _day(end) + timedelta(days=1)}
    return {name: F.to_utc_timestamp(F.lit(f"{day} 00:00:00").cast("timestamp"), tz) for name, day in midnights.items()}


def local_date(ts: str | Column, tz: str | Column) -> Column:
    return F.to_date(store_time(ts, tz))


def iso_week(day: str | Column) -> Column:
    """ISO week label such as 2020-W53; the year is the ISO week-based year."""
    d = _col(day)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def period_columns(day: str | Column) -> dict[str, Column]:
    """The four period labels of a date or a store-local timestamp, all as text."""
    d = _col(day)
    return {
        "date": F.date_format(d, "yyyy-MM-dd"),
        "month": F.date_format(d, "yyyy-MM"),
        "year": F.date_format(d, "yyyy"),
        "week": iso_week(d),
    }


def with_period_keys(df: DataFrame, ts: str | Column, tz: str | Column) -> DataFrame:
    """Add date, month, year and week of a UTC instant in the store's zone."""
    return df.withColumns(period_columns(store_time(ts, tz)))


def with_day_keys(df: DataFrame, day: str | Column) -> DataFrame:
    """Add date, month, year and week of a DATE column (ad snapshots, calendar days)."""
    return df.withColumns(period_columns(day))


def utc_parts(ts: str | Column, prefix: str) -> dict[str, Column]:
    """UTC year, month and day of an instant as text; the year is the partition key of a model."""
    t = _col(ts)
    return {
        f"{prefix}_year": F.date_format(t, "yyyy"),
        f"{prefix}_month": F.date_format(t, "MM"),
        f"{prefix}_day": F.date_format(t, "dd"),
    }


def days_in_month(day: str | Column) -> Column:
    return F.dayofmonth(F.last_day(_col(day)))


def in_local_range(ts: str | Column, tz: str | Column, start: str | date, end: str | date) -> Column:
    """Local date within [start, end].

    A zone shift is at most 14 hours, so plain bounds on the raw instant one day wider are implied.
    They reach the Parquet scan as pushed filters, which the zone-shifted test alone cannot. Rows with their
    store's own bounds are compared with those.
    """
    t, first, last = _col(ts), _day(start), _day(end)
    low = F.lit(f"{first - timedelta(days=1)} 00:00:00").cast("timestamp")
    high = F.lit(f"{last + timedelta(days=2)} 00:00:00").cast("timestamp")
    if isinstance(tz, str) and tz == OWN_ZONE:
        inside = (t >= F.col(ZONE_LOW)) & (t < F.col(ZONE_HIGH))
    else:
        inside = local_date(t, tz).between(F.lit(first), F.lit(last))
    return (t >= low) & (t < high) & inside


def utc_years(start: str | date, end: str | date) -> tuple[int, int]:
    """UTC years that may hold instants of the local range [start, end]."""
    return (_day(start) - timedelta(days=1)).year, (_day(end) + timedelta(days=1)).year


def in_utc_years(ts: str | Column, start: str | date, end: str | date) -> Column:
    """Instant within the UTC years of [start, end], as plain bounds that reach the scan."""
    t = _col(ts)
    low = F.lit(f"{_day(start).year}-01-01 00:00:00").cast("timestamp")
    high = F.lit(f"{_day(end).year + 1}-01-01 00:00:00").cast("timestamp")
    return (t >= low) & (t < high)


def prune_years(df: DataFrame, year_column: str, years: tuple[int, int]) -> DataFrame:
    """Restrict a model to UTC years by its partition column, where it has one."""
    if year_column not in df.columns:
        return df
    return df.where(F.col(year_column).cast("int").between(*years))


def grain_column(grain: str, allowed: tuple[str, ...] = GRAINS) -> str:
    if grain not in allowed:
        raise ValueError(f"grain must be one of {allowed}, got {grain!r}")
    return grain
