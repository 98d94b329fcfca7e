"""Calendar buckets: the start of a bucket, the label it is known by, and the step between starts.

Gap filling always runs on starts, which step uniformly; week, month, quarter and year ends only appear in the label.
A multiple (``2D``, ``2W``, ``3MS``) counts its units from the first bucket of each series: buckets labelled by their
start begin there, buckets labelled by their end have their first end there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1024  # steps per array when gaps are filled


@dataclass(frozen=True)
class Bucket:
    """``unit`` is day, month or second and ``size`` their number in a step; ``every`` steps make a bucket."""

    name: str
    start: Callable[[Column], Column]
    label: Callable[[Column], Column]
    unit: str
    size: int
    every: int = 1
    ends: bool = False
    workdays: bool = False

    @property
    def intraday(self) -> bool:
        return self.unit == "second"

    def between(self, first: Column, second: Column) -> Column:
        """Whole steps (of one unit size) from one start to another."""
        if self.workdays:
            # both are working days: five for every seven, and those of the rest
            days = F.datediff(second, first)
            return days - 2 * F.floor((days + F.weekday(first)) / 7)
        if self.unit == "month":
            steps = (F.year(second) - F.year(first)) * 12 + F.month(second) - F.month(first)
        elif self.unit == "day":
            steps = F.datediff(second, first)
        else:
            steps = F.timestamp_diff("SECOND", first, second)
        return F.floor(steps / self.size)

    def advance(self, start: Column, count: Column) -> Column:
        """The start that lies ``count`` steps after another."""
        steps = (count * self.size).cast("int" if not self.intraday else "long")
        if self.workdays:
            at = F.weekday(start) + count
            return F.date_add(start, (count + 2 * F.floor(at / 5)).cast("int"))
        if self.unit == "month":
            return F.add_months(start, steps)
        if self.unit == "day":
            return F.date_add(start, steps)
        return F.timestamp_add("SECOND", steps, start)

    def anchored(self, start: Column, first: Column) -> Column:
        """The start of the multiple that holds a unit bucket; ``first`` is the first unit bucket of the series."""
        steps = self.between(first, start) / self.every
        whole = F.ceil(steps) if self.ends else F.floor(steps)
        return self.advance(first, whole * self.every)

    def following(self, start: Column, later: Column) -> Column:
        """How many buckets begin from ``start`` up to, not including, ``later`` (null: one)."""
        return F.coalesce(F.floor(self.between(start, later) / self.every), F.lit(1)).cast("long")


def _trunc(unit: str) -> Callable[[Column], Column]:
    return lambda ts: F.trunc(ts.cast("date"), unit)


def _same(start: Column) -> Column:
    return start


# Other spellings of the same frequency.
_ALIASES = {"ME": "M", "QE": "Q", "YS": "AS", "YE": "A", "Y": "A", "W-SUN": "W"}
_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
_SECONDS = {"s": 1, "S": 1, "min": 60, "T": 60, "h": 3600, "H": 3600}

_CALENDAR = {
    "D": Bucket("D", lambda ts: ts.cast("date"), _same, "day", 1),
    "MS": Bucket("MS", _trunc("month"), _same, "month", 1),
    "M": Bucket("M", _trunc("month"), lambda s: F.last_day(s), "month", 1, ends=True),
    "QS": Bucket("QS", _trunc("quarter"), _same, "month", 3),
    "Q": Bucket("Q", _trunc("quarter"), lambda s: F.last_day(F.add_months(s, 2)), "month", 3, ends=True),
    "AS": Bucket("AS", _trunc("year"), _same, "month", 12),
    "A": Bucket("A", _trunc("year"), lambda s: F.make_date(F.year(s), F.lit(12), F.lit(31)), "month", 12, ends=True),
    # a weekend belongs to the Friday before it
    "B": Bucket("B", lambda ts: F.date_sub(ts.cast("date"), F.greatest(F.weekday(ts.cast("date")) - 4, F.lit(0))), _same, "day", 1,
                workdays=True),
}


def _week_ending(day: str, name: str) -> Bucket:
    # next_day finds the first such weekday strictly after its argument
    return Bucket(
        name,
        lambda ts: F.date_sub(F.next_day(F.date_sub(ts.cast("date"), 1), day), 6),
        lambda s: F.date_add(s, 6),
        "day", 7, ends=True,
    )


def _intraday(seconds: int, name: str) -> Bucket:
    if 86_400 % seconds == 0:
        return Bucket(name, lambda ts: F.window(ts, f"{seconds} seconds")["start"], _same, "second", seconds)
    # counted from midnight of the first day of the series
    return Bucket(name, lambda ts: F.date_trunc("second", ts).cast("timestamp_ntz"), _same, "second", 1, every=seconds)


def bucket_for(freq: str) -> Bucket:
    """Bucket rule for [n]D, [n]W (or W-MON .. W-SUN), [n]MS, M, QS, Q, AS, A, B, and n seconds, minutes or hours."""
    found = re.fullmatch(r"(\d*)\s*([A-Za-z]+(?:-[A-Za-z]{3})?)", freq.strip())
    n, word = (int(found[1] or 1), found[2]) if found else (0, "")
    name = _ALIASES.get(word.upper(), word.upper())
    if n > 0 and word in _SECONDS:
        return _intraday(n * _SECONDS[word], freq.strip())
    rule = None
    if name in _CALENDAR:
        rule = _CALENDAR[name]
    elif name == "W":
        rule = _week_ending("SUN", "W")
    elif name.startswith("W-") and name[2:] in _WEEKDAYS:
        rule = _week_ending(name[2:], name)
    if rule is None or n < 1:
        raise ValueError(
            f"unsupported frequency {freq!r}: use D, B, W, W-MON..W-SUN, MS, M, QS, Q, AS, A, multiples of them, or n s / n min / n h"
        )
    return replace(rule, every=n) if n > 1 else rule


# Season length assumed for a frequency when the caller names none.
DEFAULT_PERIOD = {"D": 7, "W": 52, "MS": 12, "M": 12, "QS": 4, "Q": 4}


def default_period(freq: str | None) -> int | None:
    if freq is None:
        return None
    return DEFAULT_PERIOD.get("W" if freq.startswith("W-") else freq)
