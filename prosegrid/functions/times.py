"""Lookback periods and time strings, for the driver and for columns."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_LOOKBACK = "1h"
STAMP = "%Y-%m-%dT%H:%M:%SZ"
_RELATIVE = re.compile(r"(\d+)([dhmMY])")


def back(now: datetime, amount: int, unit: str) -> datetime:
    """``now`` minus an amount of d(ays), h(ours), m(inutes), M(onths) or Y(ears)."""
    if unit in "dhm":
        return now - timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[unit]: amount})
    months = now.year * 12 + now.month - 1 - amount * (12 if unit == "Y" else 1)
    year, month = divmod(months, 12)
    return now.replace(year=year, month=month + 1, day=min(now.day, calendar.monthrange(year, month + 1)[1]))


def parse_time(value: str, now: datetime | None = None) -> datetime:
    """A relative period (at most five characters, before ``now``) or a time string, in UTC."""
    if len(value) <= 5:
        if not (found := _RELATIVE.fullmatch(value)):
            raise ValueError(f"{value!r} is not a number and one of d, h, m, M, Y")
        return back(now or datetime.now(timezone.utc), int(found[1]), found[2])
    if "-" not in value and ":" not in value:
        shapes = ["%Y%m%d%H%M"]
    else:
        shapes = [STAMP] if "T" in value else ["%Y-%m-%d %H:%M"]
    for shape in [*shapes, "%Y-%m-%d"]:
        try:
            return datetime.strptime(value, shape).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    raise ValueError(f"{value!r} is not a time")


def time_column(text: Column) -> Column:
    """The same absolute forms as a timestamp column; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm", "yyyyMMddHHmm", "yyyy-MM-dd")])


def epoch(text: str | None) -> int | None:
    """Epoch seconds (UTC) of a free-form time; None if it can't be read."""
    from dateutil import parser

    try:
        found = parser.parse(text)
    except (ValueError, OverflowError, TypeError):
        return None
    return int((found if found.tzinfo else found.replace(tzinfo=timezone.utc)).timestamp())


def epoch_column(text: Column) -> Column:
    return F.unix_timestamp(time_column(text))
