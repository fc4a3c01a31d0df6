"""Time windows in questions: driver-side, one question at a time."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

#: Months by name and by their usual short forms.
MONTHS = {form: i for i in range(1, 13) for form in (calendar.month_name[i].lower(), calendar.month_abbr[i].lower())} | {"sept": 9}
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))


@dataclass(frozen=True)
class Window:
    """Inclusive days and the words of the question that gave them."""

    first: date
    last: date
    phrase: str


def months_back(day: date, n: int) -> date:
    """The same day n months ago, or that month's last day."""
    year, month = divmod(day.year * 12 + day.month - 1 - n, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def _day(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _latest(month: int, day: int, today: date) -> date | None:
    """The last time that this day came, not after today; leap days may be eight years back."""
    return next((d for y in range(today.year, today.year - 9, -1) if (d := _day(y, month, day)) and d <= today), None)


def parse_window(question: str, today: date) -> Window | None:
    """The first window that a question names, in a fixed order of patterns; None without one."""

    def find(pattern: str) -> re.Match | None:
        return re.search(rf"\b{pattern}\b", question, re.I)

    if m := find(r"since\s+(\d{4})-(\d{2})-(\d{2})"):
        if first := _day(*map(int, m.groups())):
            return Window(first, today, m[0])
    if m := re.search(rf"\bsince\s+({_MONTH})\s+(\d{{1,2}})\b(?:,?\s+(\d{{4}})\b)?", question, re.I):
        month, day = MONTHS[m[1].lower()], int(m[2])
        if first := _day(int(m[3]), month, day) if m[3] else _latest(month, day, today):
            return Window(first, today, m[0])
    if m := re.search(rf"\bsince\s+({_MONTH})\b(?:,?\s+(\d{{4}})\b)?", question, re.I):
        month = MONTHS[m[1].lower()]
        if first := _day(int(m[2]), month, 1) if m[2] else _latest(month, 1, today):
            return Window(first, today, m[0])
    if m := find(rf"in\s+({_MONTH})\s+(\d{{4}})"):
        year, month = int(m[2]), MONTHS[m[1].lower()]
        return Window(date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1]), m[0])
    if (m := find(r"(?:past|last)\s+(?:(\d+)\s+)?(days?|weeks?|months?)")) and int(m[1] or 1) >= 1:
        n, unit = int(m[1] or 1), m[2].lower()
        first = today - timedelta(n) if unit.startswith("day") else today - timedelta(7 * n) if unit.startswith("week") else months_back(today, n)
        return Window(first, today, m[0])
    if m := find(r"this\s+week"):
        return Window(today - timedelta(today.weekday()), today, m[0])
    if m := find(r"this\s+month"):
        return Window(today.replace(day=1), today, m[0])
    if m := find("yesterday"):
        return Window(today - timedelta(1), today - timedelta(1), m[0])
    if m := find("today"):
        return Window(today, today, m[0])
    return None


def without_phrase(question: str, window: Window | None) -> str:
    """The question less its window's words, once."""
    return " ".join(re.sub(re.escape(window.phrase), " ", question, count=1, flags=re.I).split()) if window else question
