"""Time arithmetic and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp without time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def whole_seconds(later: Column, earlier: Column) -> Column:
    return F.floor((micros(later) - micros(earlier)) / 1_000_000)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole blocks of 24 hours."""
    return F.floor((micros(later) - micros(earlier)) / DAY_US)


def fractional_days(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_US))


def recency_weight(now: Column, ts: Column) -> Column:
    """(days + 1) ** -0.5."""
    return F.pow(fractional_days(now, ts) + 1, F.lit(-0.5))


def weekday(ts: Column | str) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


def day_name(day: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    return F.element_at(names, day.cast("int"))


def daypart(hour: Column) -> Column:
    """Thirds of a day: morning 5-12, afternoon 12-18, evening the rest."""
    return F.when((hour >= 5) & (hour < 12), "Morning").when((hour >= 12) & (hour < 18), "Afternoon").otherwise("Evening")


def time_of_day(hour: Column) -> Column:
    return F.when((hour >= 5) & (hour < 12), "Morning").when((hour >= 12) & (hour < 18), "Afternoon").when((hour >= 18) & (hour < 22), "Evening").otherwise("Night")


def delta_bucket(seconds: Column) -> Column:
    """Class of the time since the event before."""
    return (
        F.when(seconds < 0, "T_Error")
        .when(seconds <= 5, "T_0-5s")
        .when(seconds <= 30, "T_5-30s")
        .when(seconds <= 120, "T_30s-2m")
        .when(seconds <= 600, "T_2m-10m")
        .when(seconds <= 1800, "T_10m-30m")
        .otherwise("T_30m+")
    )


def age_bucket(days: Column) -> Column:
    """Class of an event's age in days."""
    return F.when(days <= 1, "D_0-1").when(days <= 7, "D_1-7").when(days <= 30, "D_7-30").when(days <= 180, "D_30-180").otherwise("D_180+")


def recency_bucket(days: Column) -> Column:
    """A coarser class of days since something."""
    return F.when(days <= 3, "R_0-3d").when(days <= 7, "R_3-7d").when(days <= 30, "R_7-30d").otherwise("R_30+d")
