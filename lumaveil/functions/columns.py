"""Native column expressions: checks, hashes, estimates. None of them leaves the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import OWN_DOMAINS, SERVICE_MAILBOXES
from .validators import INN_10, INN_12


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def _weighed(d: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(d, i) * w
    return total % 11 % 10


def luhn(c: Column) -> Column:
    d = digits(c)
    return F.char_length(d).between(13, 19) & F.call_function("luhn_check", d)


def inn(c: Column) -> Column:
    d = digits(c)
    ten = _weighed(d, INN_10) == _digit(d, 9)
    twelve = (_weighed(d, INN_12[0]) == _digit(d, 10)) & (_weighed(d, INN_12[1]) == _digit(d, 11))
    return F.when(F.char_length(d) == 10, ten).when(F.char_length(d) == 12, twelve).otherwise(False)


def snils(c: Column) -> Column:
    d = digits(c)
    total = F.lit(0)
    for i in range(9):
        total = total + _digit(d, i) * (9 - i)
    check = F.when(total > 101, total % 101).otherwise(total)
    check = F.when(check.isin(100, 101), 0).otherwise(check)
    return F.when(F.char_length(d) == 11, check == _digit(d, 9) * 10 + _digit(d, 10)).otherwise(False)


def passport(c: Column) -> Column:
    d = digits(c)
    return (F.char_length(d) == 10) & (F.left(d, F.lit(4)) != "0000") & (F.right(d, F.lit(6)) != "000000")


def phone(c: Column) -> Column:
    d = digits(c)
    return (F.char_length(d) == 11) & F.left(d, F.lit(1)).isin("7", "8") & ~d.startswith("8800")


def phone10(c: Column) -> Column:
    d = digits(c)
    return (F.char_length(d) == 10) & ~d.startswith("800")


def phone_e164(c: Column) -> Column:
    return F.char_length(digits(c)).between(10, 15)


def real_date(year: Column, month: Column, day: Column) -> Column:
    last = F.day(F.last_day(F.make_date(F.greatest(F.lit(1900), F.least(F.lit(2100), year)), F.greatest(F.lit(1), F.least(F.lit(12), month)), F.lit(1))))
    return year.between(1900, 2100) & month.between(1, 12) & (day >= 1) & (day <= last)


def numeric_date(c: Column) -> Column:
    p = F.transform(F.filter(F.split(F.trim(c), "[./-]"), lambda x: x != ""), lambda x: x.try_cast("int"))
    a, b, d = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
    ok = real_date(a, b, d) | real_date(d, a, b) | real_date(d, b, a) | real_date(a, d, b)
    return F.coalesce((F.size(p) == 3) & ok, F.lit(False))


def short_date(c: Column) -> Column:
    p = F.transform(F.filter(F.split(F.trim(c), "[./-]"), lambda x: x != ""), lambda x: x.try_cast("int"))
    a, b, d = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
    last = d.between(0, 99) & (real_date(d + 1900, a, b) | real_date(d + 1900, b, a))
    return F.coalesce((F.size(p) == 3) & (last | a.between(0, 99) & real_date(a + 1900, b, d)), F.lit(False))


def not_service_email(c: Column) -> Column:
    local, domain = F.lower(F.substring_index(c, "@", 1)), F.lower(F.substring_index(c, "@", -1))
    return ~(domain.isin(*sorted(OWN_DOMAINS)) & local.isin(*sorted(SERVICE_MAILBOXES)))


def estimate_tokens(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n == 0, 0).otherwise(F.floor(n / 3) + 1).cast("long")


def hashed_id(key: bytes, name: Column) -> Column:
    """The first 16 hex digits of the HMAC-SHA256 of an id."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, name.cast("binary")), 256))
    return F.left(F.sha2(F.concat(outer, first), 256), F.lit(16))


def find_spans(text: Column, pattern: str, category: str, confidence: float = 0.9) -> Column:
    """array<struct<start,end,category,confidence,value>> of all matches of a pattern without groups, in code points.

    The texts between matches and the matches take turns, so offsets are sums of their lengths. Most texts have no match
    and are asked only that.
    """
    spans = "array<struct<start:int,end:int,category:string,confidence:double,value:string>>"
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(F.char_length(g).alias("g"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["g"]
        b = a + F.char_length(x["v"])
        span = F.struct(a.alias("start"), b.alias("end"), F.lit(category).alias("category"), F.lit(float(confidence)).alias("confidence"), x["v"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(F.when(text.isNotNull(), F.array().cast(spans)))


_CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
#: Latin letters for Cyrillic ones, in the order of the alphabet.
_LATIN = "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh sch  y  e yu ya".split(" ")


def transliterated(c: Column) -> Column:
    """Cyrillic letters as Latin ones; a capital gives a capital first letter."""
    many = [(x, y) for x, y in zip(_CYRILLIC, _LATIN) if len(y) != 1]
    one = [(x, y) for x, y in zip(_CYRILLIC, _LATIN) if len(y) == 1]
    for x, y in many:
        c = F.replace(F.replace(c, F.lit(x), F.lit(y)), F.lit(x.upper()), F.lit(y.capitalize()))
    return F.translate(c, "".join(x + x.upper() for x, _ in one), "".join(y + y.upper() for _, y in one))


def new_id() -> Column:
    """A random id of version 4."""
    return F.uuid()
