"""Rule-driven detection in one text: patterns, then predicates on the match and on the words around it."""

from __future__ import annotations

import re
from dataclasses import fields
from functools import cached_property, lru_cache

import ahocorasick
import regex

from ..functions.lexicon import BIRTH_WORDS, BIRTH_WORDS_AFTER, CATEGORIES, RULES, Rule
from ..functions.validators import VALIDATORS

#: (start, end, category, detector, confidence), in code points
Span = tuple[int, int, str, str, float]
SOFT_WINDOW, BONUS_WINDOW = 25, 60
TRAILING = " -.,  "
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def from_re2(pattern: str) -> str:
    """The pattern with RE2's ASCII meaning of \\b, \\d and \\s, for the engine used here."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            two = pattern[at : at + 2]
            if two == "\\x" and pattern[at + 2 : at + 3] == "{":
                end = pattern.index("}", at)
                out.append(regex.escape(chr(int(pattern[at + 3 : end], 16))))
                at = end + 1
                continue
            plain = {"\\d": "0-9", "\\s": " \\t\\n\\f\\r"}.get(two)
            if plain:
                out.append(plain if inside else f"[{plain}]")
            elif two == "\\b" and not inside:
                out.append(_EDGE)
            else:
                out.append(two)
            at += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        out.append(c)
        at += 1
    return "".join(out)


@lru_cache(maxsize=None)
def compiled(pattern: str, fold: bool = False):
    return regex.compile(from_re2(pattern), regex.IGNORECASE if fold else 0)


_DATE_LIKE = (
    r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|"
    r"октября|ноября|декабря|янв|фев|мар|апр|май|июн|июл|авг|сен|сент|окт|ноя|дек)\.?\s+\d{2,4}"
)


CYRILLIC = re.compile("[А-Яа-яЁё]")


class Text:
    """A text with its lower-case form of equal length (letters that change their length stay as they are)."""

    def __init__(self, raw: str):
        self.raw = raw
        self.keywords: set[str] = set()
        self.regions: dict[str, list[tuple[int, int, int]]] = {}
        low = raw.lower()
        self.low = low if len(low) == len(raw) else "".join(c.lower() if len(c.lower()) == 1 else c for c in raw)

    @cached_property
    def cyrillic(self) -> bool:
        return not self.raw.isascii() and CYRILLIC.search(self.raw) is not None

    def before(self, at: int, n: int) -> str:
        return self.low[max(0, at - n) : at]

    def after(self, at: int, n: int) -> str:
        return self.low[at : at + n]


@lru_cache(maxsize=4096)
def _keywords(words: tuple[str, ...]):
    edge = "[a-zа-яё]"
    longest = "|".join(regex.escape(w) for w in sorted(set(words), key=len, reverse=True))
    return regex.compile(rf"(?<!{edge})(?:{longest})(?!{edge})")


def _present(window: str, words: tuple[str, ...]):
    """The pattern of those keywords that the window holds at all; None without one."""
    some = tuple(w for w in words if w in window)
    return _keywords(some) if some else None


def left_word(t: Text, at: int, n: int, words: tuple[str, ...], date_gap: bool = False) -> int | None:
    """Characters between `at` and the end of the nearest keyword before it, a whole word; None without one.

    A date between the two breaks the tie, unless date_gap.
    """
    window = t.before(at, n)
    one = _present(window, words)
    if one is None:
        return None
    best = max((m.end() for m in one.finditer(window)), default=None)
    if best is None or not date_gap and compiled(_DATE_LIKE).search(window[best:]):
        return None
    return len(window) - best


def right_word(t: Text, at: int, n: int, words: tuple[str, ...]) -> int | None:
    window = t.after(at, n)
    one = _present(window, words)
    m = one.search(window) if one else None
    if not m or compiled(_DATE_LIKE).search(window[: m.start()]):
        return None
    return m.start()


def left_part(t: Text, at: int, n: int, parts: tuple[str, ...]) -> int | None:
    """As left_word, but for parts of words."""
    window = t.before(at, n)
    best = max((window.rfind(p) + len(p) for p in parts if p in window), default=None)
    return None if best is None else len(window) - best


def birth_or_date(t: Text, start: int, end: int) -> str:
    near = left_word(t, start, 120, BIRTH_WORDS) is not None or right_word(t, end, 40, BIRTH_WORDS_AFTER) is not None
    return "birth_date" if near else "date"


def _in_digits(raw: str, start: int, end: int) -> bool:
    """Whether a group of digits stands next to the match behind one space or dash."""
    token = r"[^ -]+"
    if start >= 2 and raw[start - 1] in " -":
        m = regex.search(token + r"$", raw[max(0, start - 64) : start - 1])
        if m and regex.fullmatch("[0-9]+", m.group()):
            return True
    if end + 1 < len(raw) and raw[end] in " -":
        m = regex.match(token, raw[end + 1 : end + 65])
        if m and regex.fullmatch("[0-9]+", m.group()):
            return True
    return False


def _bounds(rule: Rule, m) -> tuple[int, int]:
    if rule.group:
        return m.span(rule.group)
    found = [m.span(g) for g in range(1, m.re.groups + 1) if m.start(g) >= 0]
    return (found[0][0], found[-1][1]) if found else m.span()


REACH = 64


def regions(t: Text, mark: str) -> list[tuple[int, int, int]]:
    """Stretches of the text within REACH characters of a mark, which each match holds, and how many of the marks' characters a
    match there can hold."""
    out: list[list[int]] = []
    before = own = 0
    for m in compiled(mark).finditer(t.raw):
        start, end = m.span()
        a, b = max(0, start - REACH), min(len(t.raw), end + REACH)
        own = end - start + (own if out and "@" not in t.raw[before:start] else 0)  # no match goes over an @
        if out and a <= out[-1][1]:
            out[-1][1] = b
            out[-1][2] = max(own, out[-1][2])
        else:
            own = end - start
            out.append([a, b, own])
        before = end
    return [(a, b, n) for a, b, n in out]


def matches(t: Text, rule: Rule):
    mark = r"\d+" if rule.least else "@"
    if mark not in t.regions:
        t.regions[mark] = regions(t, mark)
    if not t.regions[mark]:
        return
    text, pattern = t.low if rule.lower else t.raw, compiled(rule.pattern)
    for a, b, n in t.regions[mark]:
        if n >= rule.least:
            yield from pattern.finditer(text, a, b)


def category_of(t: Text, start: int, end: int, rule: Rule) -> str:
    """The rule's category, or the first other one whose keyword stands on its side of the match."""
    if rule.dates:
        return birth_or_date(t, start, end)
    for category, left, right in rule.reclassify:
        if left and left_word(t, start, rule.left, left) is not None or right and right_word(t, end, rule.right, right) is not None:
            return category
    return rule.category


def from_config(items: list[dict]) -> tuple[Rule, ...]:
    """Rules from a configuration (lists of fields by name), keywords in lower case; raises on what cannot work."""
    known = {f.name for f in fields(Rule)}
    out = []
    for item in items:
        name = item.get("name", "")
        if unknown := set(item) - known:
            raise ValueError(f"rule {name!r}: unknown fields {sorted(unknown)}")
        if item.get("category") not in CATEGORIES:
            raise ValueError(f"rule {name!r}: unknown category {item.get('category')!r}")
        if item.get("validator", "") not in ("", *VALIDATORS):
            raise ValueError(f"rule {name!r}: unknown validator {item['validator']!r}")
        try:
            compiled(item["pattern"])
        except (KeyError, regex.error) as e:
            raise ValueError(f"rule {name!r}: {e}") from e
        words = {k: tuple(w.lower() for w in item[k]) for k in ("soft", "context", "after", "reject", "deny", "tags") if k in item}
        other = tuple((c, tuple(w.lower() for w in a), tuple(w.lower() for w in b)) for c, a, b in item.get("reclassify", ()))
        if unknown := {c for c, _, _ in other} - set(CATEGORIES):
            raise ValueError(f"rule {name!r}: unknown categories {sorted(unknown)}")
        out.append(Rule(**(item | words | {"reclassify": other, "least": item.get("least", 1)})))
    return tuple(out)


def match_rule(t: Text, rule: Rule) -> list[Span]:
    out: list[Span] = []
    if rule.required and not any(w in t.keywords for w in rule.context + rule.after + rule.soft):
        return out
    for m in matches(t, rule):
        start, end = _bounds(rule, m)
        if start < 0:
            continue
        end = start + len(t.raw[start:end].rstrip(TRAILING))
        value = t.raw[start:end]
        soft = False
        if rule.validator and not VALIDATORS[rule.validator](value):
            soft = bool(rule.soft) and left_word(t, start, SOFT_WINDOW, rule.soft) is not None
            if not soft:
                continue
        if start and t.raw[start - 1] in "0123456789" or end < len(t.raw) and t.raw[end] in "0123456789":
            continue
        if rule.alone_in_digits and _in_digits(t.raw, start, end):
            continue
        if any(w in t.before(start, rule.reject_within) or w in t.after(end, rule.reject_within) for w in rule.reject):
            continue
        if rule.deny and (denied := left_part(t, start, rule.deny_within, rule.deny)) is not None:
            own = left_word(t, start, rule.left, rule.context)
            if own is None or denied < own:
                continue
        distance = left_word(t, start, rule.left, rule.context, rule.date_gap)
        if distance is None:
            distance = right_word(t, end, rule.right, rule.after)
        if rule.required and distance is None and not soft:
            continue
        confidence = rule.confidence - 0.2 * soft
        if distance is not None:
            confidence += 0.05 + 0.01 * (1 - distance / BONUS_WINDOW)
        out.append((start, end, category_of(t, start, end, rule), "regex", confidence))
    return out


@lru_cache(maxsize=16)
def automaton(rules: tuple[Rule, ...]):
    """Finds the keywords of rules that need one, all in one pass; None without any."""
    words = {w for r in rules if r.required for w in r.context + r.after + r.soft}
    if not words:
        return None
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def detect(t: Text, rules: tuple[Rule, ...] = RULES) -> list[Span]:
    marks = regions(t, r"\d+")
    t.regions[r"\d+"] = marks
    most = max((n for _, _, n in marks), default=0)
    words = automaton(rules)
    t.keywords = {w for _, w in words.iter(t.low)} if most and words else set()
    return [s for r in rules if r.least <= most and (r.least or "@" in t.raw) and (t.keywords or not r.required) for s in match_rule(t, r)]
