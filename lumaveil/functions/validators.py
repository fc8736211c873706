"""Checks of matched values, by name, as plain functions; their column twins are in columns.py."""

from __future__ import annotations

import re
from collections.abc import Callable

from .lexicon import MONTHS, OWN_DOMAINS, SERVICE_MAILBOXES

INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = ((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(s: str) -> bool:
    d = [int(c) for c in digits(s)]
    if not 13 <= len(d) <= 19:
        return False
    doubled = sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
    return (sum(d[-1::-2]) + doubled) % 10 == 0


def _weighed(d: list[int], weights: tuple[int, ...]) -> int:
    return sum(w * x for w, x in zip(weights, d)) % 11 % 10


def inn(s: str) -> bool:
    d = [int(c) for c in digits(s)]
    if len(d) == 10:
        return _weighed(d, INN_10) == d[9]
    return len(d) == 12 and all(_weighed(d, w) == d[len(w)] for w in INN_12)


def snils(s: str) -> bool:
    d = [int(c) for c in digits(s)]
    if len(d) != 11:
        return False
    total = sum(x * (9 - i) for i, x in enumerate(d[:9]))
    check = total % 101 if total > 101 else total
    return (0 if check in (100, 101) else check) == d[9] * 10 + d[10]


def passport(s: str) -> bool:
    d = digits(s)
    return len(d) == 10 and d[:4] != "0000" and d[4:] != "000000"


def phone(s: str) -> bool:
    d = digits(s)
    return len(d) == 11 and d[0] in "78" and not d.startswith("8800")


def phone10(s: str) -> bool:
    d = digits(s)
    return len(d) == 10 and not d.startswith("800")


def phone_e164(s: str) -> bool:
    return 10 <= len(digits(s)) <= 15


def real_date(year: int, month: int, day: int) -> bool:
    if not (1900 <= year <= 2100 and 1 <= month <= 12):
        return False
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    last = 29 if month == 2 and leap else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]
    return 1 <= day <= last


_DAY = r"([0-9]{1,2})(?:-го|-е|-ого|-его)?"
_WORDS = re.compile(_DAY + r"[ \t\n\f\r]+([a-zа-яё]+)\.?[ \t\n\f\r]+([0-9]{4})(?:[ \t\n\f\r]+(?:г\.|года|г))?")
_YEAR_FIRST = re.compile(r"([0-9]{4})[ \t\n\f\r]+г\.?[ \t\n\f\r]*,?[ \t\n\f\r]+" + _DAY + r"[ \t\n\f\r]+([а-яё]+)")
_SHORT = re.compile(r"([0-9]{1,2})(?:-го|-е|-ого|-его)[ \t\n\f\r]+([а-яё]+)[ \t\n\f\r]+([0-9]{2})-го")


def _three(s: str) -> tuple[int, int, int] | None:
    parts = [p for p in re.split(r"[./-]", s) if p]
    return tuple(map(int, parts)) if len(parts) == 3 and all(re.fullmatch("[0-9]+", p) for p in parts) else None


def date(s: str) -> bool:
    """A real day from 1900 to 2100 in words, or in numbers in any order that has the year at an end."""
    s = s.strip().lower()
    if m := _WORDS.fullmatch(s):
        return m[2] in MONTHS and real_date(int(m[3]), MONTHS[m[2]], int(m[1]))
    if m := _YEAR_FIRST.fullmatch(s):
        return m[3] in MONTHS and real_date(int(m[1]), MONTHS[m[3]], int(m[2]))
    if not (abc := _three(s)):
        return False
    a, b, c = abc
    return any(real_date(*x) for x in ((a, b, c), (c, a, b), (c, b, a), (a, c, b)))


def date_short_year(s: str) -> bool:
    """Two-digit years are of the 1900s, last (either order of day and month) or first."""
    if not (abc := _three(s.strip())):
        return False
    a, b, c = abc
    return c <= 99 and (real_date(1900 + c, a, b) or real_date(1900 + c, b, a)) or a <= 99 and real_date(1900 + a, b, c)


def date_word_short_year(s: str) -> bool:
    m = _SHORT.fullmatch(re.sub(r"[^\w]+$", "", s.strip().lower()))
    return bool(m) and m[2] in MONTHS and real_date(1900 + int(m[3]), MONTHS[m[2]], int(m[1]))


def not_service_email(s: str) -> bool:
    local, _, domain = s.lower().partition("@")
    return not (domain in OWN_DOMAINS and local in SERVICE_MAILBOXES)


def not_toll_free(s: str) -> bool:
    d = digits(s)
    return not (len(d) == 11 and d.startswith("8800"))


VALIDATORS: dict[str, Callable[[str], bool]] = {
    f.__name__: f
    for f in (luhn, inn, snils, passport, phone, phone10, phone_e164, date, date_short_year, date_word_short_year, not_service_email, not_toll_free)
}
