"""Addresses: parts of an address are found one by one, neighbours make groups, and a group counts by what it holds.

A street with a house, or a locality with anything else, is an address; other groups need a word of living or delivery
before them. A bank's or office's address is not a person's, unless a word of living stands nearer.
"""

from __future__ import annotations

import regex

from ..functions.dictionaries import TOWNS
from .places import declined
from .rules import Span, Text

# Words and marks of addresses.
LIVING = ("адрес", "проживает", "прописан", "зарегистрирован", "проживающий", "место жительства", "доставка", "доставить", "живу", "живёт", "снимаю", "проживаю", "прописка", "почтовый адрес")
ORGANISATION = ("отделени", "офис", "банкомат", "филиал", "юридическ", "юрадрес", "головн", "отель", "гостиниц", "конференц")
ORGANISATION_WORDS = ("пункт выдачи", "адрес банка", "до", "банка", "банке")
PERSONAL = (
    "живу", "живёт", "живет", "проживаю", "проживает", "прописан", "прописана", "зарегистрирован", "зарегистрирована", "адрес регистрации", "адрес проживания", "мой адрес",
    "домашний адрес", "фактический адрес", "прописка",
)
NO_STREET = frozenset(
    "паспорт серия снилс инн телефон тел карта счёт счет заказ договор код пин cvc cvv выдан выдано получатель клиент оператор фио ф.и.о адрес адресу адреса адресе проживаю "
    "проживает живу живёт живет снимаю прописка регистрации регистрация".split()
)
STREETS = r"улица|улице|улицу|проспекте|проспект|переулок|бульвар|шоссе|набережная|площадь|проезд|тупик|аллея|линия|пр-кт|пр-т|пр-д|б-р|ул|пр|пер|ш|наб|пл"
_STREETS = rf"(?:{STREETS})(?:\.|(?!\p{{L}}))"
_HOUSE = r"[0-9]{1,4}[а-яa-z]?(?:\s*/\s*[0-9]+)?(?:\s*-\s*[0-9]+)?(?:\s*(?:корпус|корп\.|к\.|к)\s*[0-9]+)?(?:\s*(?:строение|стр\.|с)\s*[0-9]+)?(?![0-9])"
_STOP = rf"(?:{STREETS}|дом|д|кв|квартира|корп|корпус|стр|строение|офис|оф)(?!\p{{L}})"
_NAME = rf"(?!{_STOP})[А-ЯЁ0-9][А-ЯЁа-яё0-9-]*"

#: (kind, pattern): of the lower-case text.
LOWER = tuple(
    (kind, regex.compile(rf"(?<!\p{{L}})(?:{pattern})"))
    for kind, pattern in (
        ("index", r"(?<![0-9])[1-6][0-9]{5}(?![0-9])"),
        ("country", r"(?:российская федерация|республика беларусь|россия|рф|казахстан|беларусь|армения|узбекистан)(?!\p{L})"),
        ("region", r"[а-яё-]+\s+(?:область|обл\.|край|автономный округ|ао)(?!\p{L})|(?:республика|респ\.)\s+[а-яё-]+"),
        ("district", r"[а-яё-]+\s+(?:район|р-н)(?!\p{L})"),
        ("house", rf"(?:дом|доме|д\.|д)\s*{_HOUSE}|(?:стр\.|строение|корпус|корп\.)\s*[0-9]+[а-яa-z]?(?![0-9])"),
        ("flat", r"(?:кв\.|кв|квартира|квартире|офис|оф\.|помещение|пом\.|комн\.)\s*[0-9]+[а-я]?(?![0-9])|(?:кв\.|квартира)\s+(?:[а-яё]+(?:надцать|дцать|сять|десят|сорок|один|два|три|четыре|пять|шесть|семь|восемь|девять))(?!\p{L})"),
        ("box", r"а/я\s*[0-9]+"),
    )
)
#: Of the text as it is, where capitals tell a name.
EXACT = tuple(
    (kind, regex.compile(pattern))
    for kind, pattern in (
        ("locality", rf"(?i:(?<!\p{{L}})(?:город|городе|гор\.|г\.|посёлок|поселок|пос\.|село|с\.|деревня|дер\.|станица|ст\.|пгт|микрорайон|мкр\.))\s*{_NAME}(?:\s+{_NAME}){{0,2}}"),
        ("locality", r"\([А-ЯЁ][а-яё-]+\)"),
        ("street", rf"(?i:(?<!\p{{L}}){_STREETS})\s*(?:[0-9]+-?[а-я]*\s+)?(?!(?i:банк[аеу])(?!\p{{L}})){_NAME}\.?(?:\s+(?!{_STOP})[А-ЯЁ][а-яё-]*\.?){{0,2}}"),
        ("street", rf"(?<!\p{{L}})(?!Горячая)[А-ЯЁ][а-яё-]+(?:\s+[А-ЯЁ][а-яё-]+)?\s+{_STREETS}"),
    )
)
TOWN = regex.compile(r"(?<![\p{L}-])(?:" + "|".join(sorted({regex.escape(f) for t in TOWNS for f in declined(t)}, key=len, reverse=True)) + r")(?![\p{L}-])")
BARE_HOUSE = regex.compile(rf"\s?,?\s*{_HOUSE}(?![.0-9])")
BARE_STREET = regex.compile(rf"[ ,]{{0,3}}((?!{_STOP})[А-ЯЁ][а-яё-]+(?:\s+[А-ЯЁ][а-яё-]+){{0,2}}\s*,?\s*{_HOUSE}(?![.:0-9])(?:\s*,\s*(?:кв\.|квартира)\s*[0-9]+[а-я]?)?)")
LABEL = regex.compile(
    r"(?<!\p{L})(?:страна проживания|страна|индекс|город|улица|дом|квартира|кв\.|кв|region|country|index|zip|city|street|building|apt)(?:\s*[:=]\s*|\s+[-—]\s+)"
)


def parts(t: Text) -> list[tuple[int, int, str]]:
    found = [(*m.span(), kind) for kind, p in LOWER for m in p.finditer(t.low)] + [(*m.span(), kind) for kind, p in EXACT for m in p.finditer(t.raw)]
    found += [(*m.span(), "locality") for m in TOWN.finditer(t.low) if t.raw[m.start()].isupper()]
    for a, b, kind in list(found):
        if kind == "street" and (m := BARE_HOUSE.match(t.raw, b)):
            found.append((b, m.end(), "house"))
        elif kind == "locality" and (m := BARE_STREET.match(t.raw, b)) and m.group(1).split()[0].lower() not in NO_STREET:
            found.append((*m.span(1), "street and house"))
    for w in LIVING:
        at = t.low.find(w)
        while at >= 0:
            m = BARE_STREET.search(t.raw, at + len(w), at + len(w) + 60)
            if m and m.start(1) - at - len(w) <= 30 and m.group(1).split()[0].rstrip(",").lower() not in NO_STREET:
                found.append((*m.span(1), "street and house"))
            at = t.low.find(w, at + 1)
    return found


def labelled(t: Text) -> list[tuple[int, int, str]]:
    """Values of the fields of a form, up to the next label or the end of the line or sentence."""
    labels = list(LABEL.finditer(t.low))
    out = []
    for m, following in zip(labels, [*labels[1:], None]):
        line = t.raw.find("\n", m.end())
        stop = following.start() if following else line if line >= 0 else len(t.raw)
        value = t.raw[m.end() : stop]
        if own := regex.search(r"\.(?= \p{Lu})", value):
            value = value[: own.start()]
        value = regex.sub(r"[\s,;]+$", "", value)
        value = value[:-1] if regex.search(r"[0-9]\.$", value) else value
        if value:
            out.append((m.end(), m.end() + len(value), "label"))
    return out


def joined(t: Text, a: int, b: int) -> bool:
    """Whether what lies between a and b keeps two parts together."""
    between = t.raw[a:b]
    return len(between) <= 3 and not regex.search(r"[!?\n]", between) and not (". " in between and t.raw[b : b + 1].isupper())


def of_organisation(t: Text, at: int) -> bool:
    clause = regex.split(r"[,.!?\n]", t.before(at, 60))[-1]
    theirs = max([clause.rfind(w) for w in ORGANISATION] + [m.start() for w in ORGANISATION_WORDS for m in regex.finditer(rf"(?<!\p{{L}}){w}(?!\p{{L}})", clause)])
    return theirs >= 0 and max(clause.rfind(w) for w in PERSONAL) < theirs


def addresses(t: Text) -> list[Span]:
    found = sorted([*parts(t), *labelled(t)], key=lambda x: (x[0], -x[1], x[2] != "label"))
    kept: list[tuple[int, int, str]] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    out, i = [], 0
    while i < len(kept):
        n = i + 1
        while n < len(kept) and joined(t, kept[n - 1][1], kept[n][0]):
            n += 1
        kinds = {k for _, _, k in kept[i:n]}
        start, end = kept[i][0], kept[n - 1][1]
        street, house = bool(kinds & {"street", "street and house"}), bool(kinds & {"house", "street and house"})
        whole = "label" in kinds or street and house or "locality" in kinds and len(kinds) > 1
        if (whole or any(w in t.before(start, 30) for w in LIVING)) and not of_organisation(t, start):
            value = t.raw[start:end]
            out.append((start, start + len(value.rstrip(" ,")), "address", "address", 0.9))
        i = n
    return out
