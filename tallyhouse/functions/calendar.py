"""Reporting periods as plain dates, so that filters on them are literals."""

from __future__ import annotations

from datetime import date, timedelta

Window = tuple[date, date]


def add_months(day: date, n: int) -> date:
    """n months on, within the month's end."""
    year, month = divmod(day.year * 12 + day.month - 1 + n, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


def period_bounds(month_start: date) -> dict[str, Window]:
    """month, t3m, t12m and their twins a year before; ends are exclusive."""
    end = add_months(month_start, 1)
    found = {name: (add_months(end, -n), end) for name, n in (("month", 1), ("t3m", 3), ("t12m", 12))}
    return found | {f"{name}_prior": (add_months(a, -12), add_months(b, -12)) for name, (a, b) in found.items()}


def cagr_years(month_start: date, years: int) -> tuple[Window, Window]:
    """The first and last calendar year of a trend of so many years."""
    year = lambda y: (date(y, 1, 1), date(y + 1, 1, 1))
    return year(month_start.year - years + 1), year(month_start.year)


def annual_periods(month_start: date, n: int) -> list[Window]:
    """n periods of twelve months, the latest first, which ends with month_start's month."""
    end = add_months(month_start, 1)
    return [(add_months(end, -12 * (k + 1)), add_months(end, -12 * k)) for k in range(n)]


def ends_of(periods: list[Window]) -> list[Window]:
    """The earliest and the latest period; one if they are the same."""
    return sorted({min(periods), max(periods)})


def trailing_weeks(day: date, weeks: int) -> Window:
    """The weeks up to a day that counts too; the end is exclusive."""
    return day - timedelta(weeks=weeks), day + timedelta(days=1)


def calendar_years(day: date, n: int) -> Window:
    """n calendar years that end with the day's year."""
    return date(day.year - n + 1, 1, 1), date(day.year + 1, 1, 1)
