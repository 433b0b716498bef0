"""Time predicates as columns; the reference time is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}


def _day(ref: str) -> Column:
    return F.to_timestamp_ntz(F.date_format(F.lit(ref).cast("timestamp_ntz"), "yyyy-MM-dd").cast("string"))


def _plus(start: Column, unit: str, n: int) -> Column:
    return (start + F.expr(f"interval {n} {unit}")).cast("timestamp_ntz")


def _trunc(unit: str, ref: str) -> Column:
    return F.date_trunc(unit, F.lit(ref).cast("timestamp_ntz")).cast("timestamp_ntz")


def period_bounds(period: str, ref: str, n: int | None = None, month: str | None = None, year: int | None = None, quarter: int | None = None) -> tuple[Column, Column]:
    """Half-open [start, end) of a named calendar period seen from `ref`."""
    today = _day(ref)
    if period == "today":
        return today, _plus(today, "day", 1)
    if period == "yesterday":
        return _plus(today, "day", -1), today
    if period in ("this_week", "last_week", "this_month", "last_month", "this_quarter", "last_quarter", "this_year", "last_year"):
        when, unit = period.split("_")
        start = _trunc(unit, ref)
        step = ("month", 3) if unit == "quarter" else (unit, 1)
        return (start, _plus(start, *step)) if when == "this" else (_plus(start, step[0], -step[1]), start)
    if period in ("last_n_days", "last_n_weeks", "last_n_months"):
        days = n * {"days": 1, "weeks": 7, "months": 30}[period.rpartition("_")[2]]
        return _plus(today, "day", -days), _plus(today, "day", 1)
    if period == "n_days_ago":
        return _plus(today, "day", -n), _plus(today, "day", 1 - n)
    if period == "n_weeks_ago":
        start = _plus(_trunc("week", ref), "week", -n)
        return start, _plus(start, "week", 1)
    if period == "quarter":
        start = F.lit(f"{year}-{3 * quarter - 2:02d}-01").cast("timestamp_ntz")
        return start, _plus(start, "month", 3)
    if period == "month":
        start = F.lit(f"{year}-{_MONTHS[month.lower()]:02d}-01").cast("timestamp_ntz")
        return start, _plus(start, "month", 1)
    if period == "year":
        start = F.lit(f"{year}-01-01").cast("timestamp_ntz")
        return start, _plus(start, "year", 1)
    raise ValueError(f"unknown period {period!r}")


def period_filter(col: Column, period: str, ref: str, **more) -> Column:
    """whether `col` falls in the named period (its last instant included: the end is 23:59:59.999999)."""
    start, end = period_bounds(period, ref, **more)
    return (col >= start) & (col < end)


def range_filter(col: Column, ref: str | None = None, since: str | None = None, before: str | None = None, after: str | None = None, on: str | None = None, between: tuple[str, str] | None = None) -> Column:
    """since a day, before one (from a year earlier), after one (from the next day), on one, between two (closed)."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    if since:
        return (col >= ts(since)) & (col < _plus(_day(ref), "day", 1)) if ref else col >= ts(since)
    if before:
        return (col >= _plus(ts(before), "year", -1)) & (col < ts(before))
    if after:
        return col >= _plus(ts(after), "day", 1)
    if on:
        return (col >= ts(on)) & (col < _plus(ts(on), "day", 1))
    return (col >= ts(between[0])) & (col < _plus(ts(between[1]), "day", 1))


def overlaps(start: Column, end: Column, a: Column, b: Column) -> Column:
    """closed intervals [start, end] and [a, b] share a point; null ends are open."""
    return (start.isNull() | (start <= b)) & (end.isNull() | (end >= a))


def in_range(ts: Column, a: Column, b: Column, closed: bool = True) -> Column:
    """containment, closed or half-open."""
    return (ts >= a) & ((ts <= b) if closed else (ts < b))


def last_days(df: DataFrame, ts: str, n: int, now: str) -> DataFrame:
    """rows of the last `n` days before `now`."""
    return df.where(F.col(ts) >= _plus(F.lit(now).cast("timestamp_ntz"), "day", -n))
