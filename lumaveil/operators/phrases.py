"""Detection by word lists and small grammars: dates in words, card holders."""

from __future__ import annotations

import regex

from .rules import Span, Text, birth_or_date, left_word, right_word

# Word lists of the language.
_UNITS = "перв втор трет четверт пят шест седьм восьм девят".split()
_TEENS = "десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат".split()
_TENS = {20: "двадцат", 30: "тридцат", 40: "сороков", 50: "пятидесят", 60: "шестидесят", 70: "семидесят", 80: "восьмидесят", 90: "девяност"}
_TENS_FIRST = {20: "двадцать", 30: "тридцать", 40: "сорок", 50: "пятьдесят", 60: "шестьдесят", 70: "семьдесят", 80: "восемьдесят", 90: "девяносто"}
_MONTH = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
HOLDER_WORDS = ("держатель", "держатель карты", "владелец карты", "cardholder", "card holder", "name on card", "имя на карте")
HOLDER_STOPS = frozenset("visa mastercard mir maestro card bank gold platinum classic debit credit world electron unionpay valid thru month year cvv cvc pin sms".split())


def _ordinals(stem: str) -> list[str]:
    return [stem + "ьего", stem + "ье"] if stem == "трет" else [stem + "ого", stem + "ое", stem + "его"]


def _days() -> list[str]:
    one = [w for s in _UNITS + _TEENS + ["двадцат", "тридцат"] for w in _ordinals(s)]
    two = ["двадцать " + w for s in _UNITS for w in _ordinals(s)] + ["тридцать " + w for w in _ordinals("перв")]
    return sorted(one + two, key=len, reverse=True)


def _years() -> str:
    last = "|".join(sorted((s + ("ьего" if s == "трет" else "ого") for s in [*_UNITS, *_TEENS, *_TENS.values()]), key=len, reverse=True))
    tens = "|".join(_TENS_FIRST.values())
    return rf"(?:тысяча\s+девятьсот\s+(?:(?:{tens})\s+)?(?:{last})|двухтысячного|две\s+тысячи\s+(?:(?:{tens})\s+)?(?:{last})|[0-9]{{4}})"


DATE_WORDS = regex.compile(rf"(?<!\p{{L}})(?:{'|'.join(_days())})\s+(?:{'|'.join(_MONTH)})\s+{_years()}(?:\s+(?:года|г\.))?(?![\p{{L}}\p{{N}}])")


def russian(find):
    """The detector for texts with Cyrillic letters only."""
    return lambda t: find(t) if t.cyrillic else []


def dates_in_words(t: Text) -> list[Span]:
    out = []
    for m in DATE_WORDS.finditer(t.low):
        if regex.search(r"(?:двадцать|тридцать)\s+$", t.low[max(0, m.start() - 12) : m.start()]):
            continue
        out.append((*m.span(), birth_or_date(t, *m.span()), "datewords", 0.85))
    return out


MANY_DIGITS = regex.compile(r"[0-9](?:[ -]?[0-9]){12}")


def holders(t: Text) -> list[Span]:
    from ..functions.validators import luhn

    near = any(w in t.low for w in HOLDER_WORDS)
    some = t.regions.get(r"\d+")  # where the rules found digits
    digits = MANY_DIGITS.search(t.raw) if some is None or any(n >= 13 for _, _, n in some) else None
    if not near and not digits:
        return []
    card = digits is not None and any(luhn(m.group()) for m in regex.finditer(r"[0-9](?:[ -]?[0-9]){12,18}", t.raw))
    out = []
    for m in regex.finditer(r"(?<![A-Za-z])[A-Za-z]+(?:-[A-Za-z]+)?(?: [A-Za-z]+(?:-[A-Za-z]+)?){1,3}(?![A-Za-z])", t.raw):
        words = m.group().split(" ")
        if any(w.lower() in HOLDER_STOPS for w in words) or max(map(len, words)) < 2:
            continue
        near = left_word(t, m.start(), 30, HOLDER_WORDS) is not None or right_word(t, m.end(), 30, HOLDER_WORDS) is not None
        upper = m.group().isupper()
        if upper and card or near and all(w[0].isupper() for w in words):
            out.append((*m.span(), "card_holder", "cardholder", 0.95 if upper and card else 0.85))
    return out
