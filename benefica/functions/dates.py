"""Date expressions; every one takes an explicit ``as_of``."""

from __future__ import annotations

import calendar
import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_years(born: Column, as_of: Column) -> Column:
    """Completed years between two dates."""
    before = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(as_of) - F.year(born) - before.cast("int")


def age_or_default(born: Column, as_of: Column, default: int = 35) -> Column:
    return F.coalesce(full_years(born, as_of), F.lit(default))


def decimal_age(born: Column, as_of: Column) -> Column:
    return F.round(F.datediff(as_of, born) / 365.25, 1)


def day_first_date(text: Column) -> Column:
    """dd/MM/yyyy, then dd-MM-yyyy, then ISO; anything else is missing."""
    text = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date")
                        for f in ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d")])


def days_since(then: Column, as_of: Column, default: int = 365) -> Column:
    return F.coalesce(F.datediff(as_of, then), F.lit(default))


def birthdate_from_age(age: Column, as_of: Column) -> Column:
    return F.when(age > 0, F.add_months(as_of, -12 * age.cast("int")))


def duration_text(hours: Column) -> Column:
    """Hours as a float to HH:MM."""
    minutes = F.round(F.abs(hours) * 60).cast("long")
    return F.concat(
        F.when(hours < 0, "-").otherwise(""),
        F.format_string("%02d:%02d", F.floor(minutes / 60).cast("long"), minutes % 60),
    )


# --- recurrence -----------------------------------------------------------------------------------------------

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def on_or_after_weekday(day: Column, weekday: str) -> Column:
    return F.next_day(F.date_sub(day, 1), weekday)


def nth_weekday(month_start: Column, n: int, weekday: str) -> Column:
    """n-th weekday of a month; n = -1 is the last one."""
    if n == -1:
        return F.date_sub(F.next_day(F.last_day(month_start), weekday), 7)
    return F.date_add(on_or_after_weekday(month_start, weekday), 7 * (n - 1))


# A grid of months meets every day that it ever meets within so many steps, fifth weekdays aside.
MONTH_STEPS, YEAR_STEPS = 24, 12


@cache
def _fifth_steps(months: int, weekday: str) -> int:
    """Steps within which a grid of months meets two fifth weekdays wherever it begins, if it ever does; the calendar repeats after 400 years."""
    hits = []
    for k in range(4800):
        first, days = calendar.monthrange(2000 + k // 12, k % 12 + 1)
        hits.append((WEEKDAYS.index(weekday) - first) % 7 + 29 <= days)
    most, around = MONTH_STEPS, 4800 // math.gcd(4800, months)
    for start in range(4800):
        met = 0
        for k in range(2 * around + 1):
            met += hits[(start + k * months) % 4800]
            if met == 2:
                most = max(most, k)
                break
    return most


def _on_grid(start: Column, months: int, steps: int, pick) -> Column:
    """``pick(first of month)`` every ``months`` months from the month of ``start``; dates outside their month do not exist."""
    def at(k: Column) -> Column:
        first = F.add_months(F.trunc(start, "month"), k * months)
        day = pick(first)
        return F.when(F.trunc(day, "month") == first, day)

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def occurrences(start: Column, rule: dict) -> Column:
    """The first occurrences of a rule whose grid begins at ``start``, in order, none before it.

    Rules: {"type": daily | weekly | monthly | yearly, "interval": n, "weekday": "Mon", "day": 10, "nth": 1}.  Months without
    the day or without an nth weekday are skipped, and so are years without the 29th of February.
    """
    kind, step = rule["type"], rule["interval"]
    if kind == "daily":
        return F.array(start, F.date_add(start, step))
    if kind == "weekly":
        day = F.date_add(F.trunc(start, "week"), WEEKDAYS.index(rule["weekday"])) if rule.get("weekday") else start
        found = F.array(*[F.date_add(day, 7 * step * k) for k in range(3)])
    elif kind == "monthly" and rule.get("nth"):
        steps = _fifth_steps(step, rule["weekday"]) if rule["nth"] == 5 else MONTH_STEPS
        found = _on_grid(start, step, steps, lambda first: nth_weekday(first, rule["nth"], rule["weekday"]))
    elif kind == "monthly":
        day = F.lit(rule["day"]) if rule.get("day") else F.dayofmonth(start)
        found = _on_grid(start, step, MONTH_STEPS, lambda first: F.date_add(first, day - 1))
    else:
        found = _on_grid(start, 12 * step, YEAR_STEPS, lambda first: F.date_add(first, F.dayofmonth(start) - 1))
    return F.filter(found, lambda d: d >= start)


def next_occurrence(current: Column, rule: dict) -> Column:
    """The occurrence after ``current``, which is one itself."""
    return F.get(occurrences(current, rule), F.lit(1))


def cycle_range(new_start: Column, rule: dict) -> tuple[Column, Column]:
    """Start and end of the cycle that begins at or after ``new_start``."""
    found = occurrences(new_start, rule)
    return F.get(found, F.lit(0)), F.date_sub(F.get(found, F.lit(1)), 1)
