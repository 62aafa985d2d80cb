"""Calendar periods and time bins as column expressions.

A period has a label (its last day) and an integer index that grows by one from
a period to the next. Windows are cut on the index, so a range condition on dates
becomes integer arithmetic.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("day", "week", "month", "year")

_CALENDAR = {"W": "week", "W-SUN": "week", "ME": "month", "M": "month", "YE": "year", "Y": "year", "A": "year"}
_SECONDS = {"D": 86400, "h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1}
DAY_SECONDS = 86400


def _check(unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, got {unit!r}")


def period_end(ts: Column | str, unit: str) -> Column:
    """Last day of the period holding ``ts`` (a date on the last day stays)."""
    _check(unit)
    day = F.to_date(ts)
    if unit == "day":
        return day
    if unit == "week":
        return F.next_day(F.date_sub(day, 1), "SU")
    if unit == "month":
        return F.last_day(day)
    return F.make_date(F.year(day), F.lit(12), F.lit(31))


def period_index(ts: Column | str, unit: str) -> Column:
    """Integer index of the period holding ``ts``."""
    _check(unit)
    day = F.to_date(ts)
    if unit == "day":
        return F.unix_date(day)
    if unit == "week":  # 1970-01-04 was a Sunday
        return F.floor((F.unix_date(day) + 3) / 7).cast("int")
    if unit == "month":
        return F.year(day) * 12 + F.month(day)
    return F.year(day)


def index_end(index: Column | str, unit: str) -> Column:
    """Last day of the period with this index (inverse of ``period_index``)."""
    _check(unit)
    i = F.col(index) if isinstance(index, str) else index
    if unit == "day":
        return F.date_from_unix_date(i.cast("int"))
    if unit == "week":
        return F.date_from_unix_date((i * 7 + 3).cast("int"))
    if unit == "month":
        first = F.make_date(F.floor((i - 1) / 12).cast("int"), (F.pmod(i - 1, F.lit(12)) + 1).cast("int"), F.lit(1))
        return F.last_day(first)
    return F.make_date(i.cast("int"), F.lit(12), F.lit(31))


def parse_frequency(freq: str) -> tuple[str, int]:
    """Offset alias -> ``("week" | "month" | "year", 1)`` or ``("fixed", seconds)``."""
    match = re.fullmatch(r"(\d*)([A-Za-z]+(?:-[A-Z]{3})?)", freq)
    if not match:
        raise ValueError(f"unknown frequency {freq!r}")
    count, alias = int(match.group(1) or 1), match.group(2)
    if alias in _SECONDS and count > 0:
        return "fixed", count * _SECONDS[alias]
    if alias in _CALENDAR and count == 1:
        return _CALENDAR[alias], 1
    raise ValueError(f"unknown frequency {freq!r}")


def needs_origin(freq: str) -> bool:
    """True if bins of this frequency are counted from the patient's first day."""
    kind, seconds = parse_frequency(freq)
    return kind == "fixed" and DAY_SECONDS % seconds != 0


def time_bin(ts: Column | str, freq: str, origin: Column | None = None) -> Column:
    """Label of the time bin of ``ts`` as ``timestamp_ntz``.

    Fixed steps are labelled by their start, calendar periods by their last day.
    Only the wall clock is used, the session time zone has no influence.
    """
    t = F.col(ts) if isinstance(ts, str) else ts
    kind, seconds = parse_frequency(freq)
    if kind != "fixed":
        return period_end(t, kind).cast("timestamp_ntz")
    if seconds == DAY_SECONDS:
        return F.to_date(t).cast("timestamp_ntz")
    into_day = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    if needs_origin(freq):
        if origin is None:
            raise ValueError(f"frequency {freq!r} does not divide a day and needs an origin")
        elapsed = F.datediff(F.to_date(t), F.to_date(origin)).cast("long") * DAY_SECONDS + into_day
    else:
        elapsed = into_day
    start = (into_day - F.pmod(elapsed, F.lit(seconds))).cast("int")  # seconds from the day's midnight
    zero = F.lit(0)
    rest = (start % 60).cast("decimal(18,6)") if seconds % 60 else zero
    shift = F.make_dt_interval(zero, zero, ((start - start % 60) / 60).cast("int"), rest)
    return F.to_date(t).cast("timestamp_ntz") + shift


def days(n: int | Column) -> Column:
    """A day-time interval of ``n`` days."""
    return F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))
