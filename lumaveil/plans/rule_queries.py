"""Queries that hold every detection rule and name shape against SQL, over texts made from the keys of customers.

The texts are made by expressions that both engines read; what SQL expects is where the value stands and, for names, which
value of the lists it is. The detectors see the texts only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import INN_10, INN_12
from ..functions.dictionaries import GIVEN_NAMES, SURNAMES, TOWNS
from ..operators import detect
from .catalogue import ORACLE_SQL, QUERIES, table

KEY = "c_custkey"


def digits(n: int, times: int, first: str = "") -> str:
    """n digits of a key, in SQL of both engines."""
    left = n - len(first)
    return f"concat('{first}', lpad(cast({KEY} * {times} % {10**left} as string), {left}, '1'))"


def part(text: str, start: int, n: int) -> str:
    return f"substr({text}, {start}, {n})"


def weighed(d: str, weights) -> str:
    total = " + ".join(f"{w} * cast(substr({d}, {i + 1}, 1) as int)" for i, w in enumerate(weights))
    return f"cast(({total}) % 11 % 10 as string)"


def with_luhn(body: str, n: int) -> str:
    """The n digits of body and their check digit."""
    each = []
    for i in range(n):
        d = f"cast(substr({body}, {i + 1}, 1) as int)"
        each.append(f"(case when {d} * 2 > 9 then {d} * 2 - 9 else {d} * 2 end)" if (n - i) % 2 else d)
    return f"concat({body}, cast((10 - ({' + '.join(each)}) % 10) % 10 as string))"


def with_snils(body: str) -> str:
    total = "(" + " + ".join(f"{9 - i} * cast(substr({body}, {i + 1}, 1) as int)" for i in range(9)) + ")"
    check = f"case when {total} < 100 then {total} when {total} in (100, 101) then 0 when {total} % 101 = 100 then 0 else {total} % 101 end"
    return f"concat({body}, lpad(cast({check} as string), 2, '0'))"


def spaced(text: str, groups: tuple[int, ...], between: str = " ") -> str:
    at, out = 1, []
    for n in groups:
        out.append(part(text, at, n))
        at += n
    return "concat(" + f", '{between}', ".join(out) + ")"


def picked(values: tuple[str, ...], times: int = 1) -> str:
    """One of the values by the key, as a case over it."""
    return f"case {KEY} * {times} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def holds(name: str, prefix: str, value: str, category: str, suffix: str = " спасибо") -> None:
    """A query: the spans of the category in prefix || value || suffix, one of each customer and just the value."""

    def run(spark, sf):
        d = table(spark, sf, "customer").select(KEY, F.expr(f"concat('{prefix}', {value}, '{suffix}')").alias("text"))
        d = detect.detect(d).select(KEY, "text", F.explode("spans").alias("s")).where(F.col("s.category") == category)
        return d.select(KEY, F.col("s.start").alias("start"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"""select {KEY}, length('{prefix}')::int as "start", {value} as value from customer"""


_INN12 = f"concat({digits(10, 7919, '50')}, {weighed(digits(10, 7919, '50'), INN_12[0])})"
_INN12 = f"concat({_INN12}, {weighed(_INN12, INN_12[1])})"
_INN10 = f"concat({digits(9, 7919, '77')}, {weighed(digits(9, 7919, '77'), INN_10)})"
_CARD = with_luhn(digits(15, 7919, "4111"), 15)
_SEVEN, _SIX = digits(7, 7919), digits(6, 104729)
_DAY, _YEAR = f"cast({KEY} % 28 + 1 as string)", f"cast({KEY} % 60 + 1940 as string)"
_MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
_MONTH = picked(tuple(_MONTHS))

holds("rule_phone_moscow", "Позвоните по номеру ", f"concat('(495) ', {part(_SEVEN, 1, 3)}, '-', {part(_SEVEN, 4, 2)}, '-', {part(_SEVEN, 6, 2)})", "phone")
holds("rule_phone_mobile", "мобильный ", f"concat('916', {_SEVEN})", "phone")
holds("rule_email", "почта ", f"concat('имя.', {KEY}, '@пример', {KEY}, '.рф')", "email", ", спасибо")
holds("rule_inn", "ИНН ", _INN12, "inn")
holds("rule_inn_legal", "инн: ", _INN10, "inn")
holds("rule_inn_spaced", "инн ", spaced(_INN12, (4, 4, 4)), "inn")
holds("rule_card_number", "карта ", spaced(_CARD, (4, 4, 4, 4)), "card_number")
holds("rule_pin", "пин-код ", digits(4, 31), "pin", ", спасибо")
holds("rule_passport_words", "паспорт серия ", f"concat('45', {part(_SIX, 1, 2)}, ' номер ', {_SIX})", "passport")
holds("rule_passport_bare", "паспортные данные ", f"concat('4509', {_SIX})", "passport")
holds("rule_division_spaced", "код подразделения ", spaced(f"concat('77', {part(_SIX, 1, 4)})", (3, 3)), "division_code")
holds("rule_division_bare", "код подразделения ", f"concat('77', {part(_SIX, 1, 4)})", "division_code")
holds("rule_driver_letters", "водительское удостоверение ", f"concat('77 АВ ', {_SIX})", "driver_license")
holds("rule_driver_labelled", "водительское удостоверение ", f"concat('77 12 № ', {_SIX})", "driver_license")
holds("rule_snils", "СНИЛС ", f"concat({spaced(with_snils(digits(9, 7919, '11')), (3, 3, 3), '-')}, ' ', {part(with_snils(digits(9, 7919, '11')), 10, 2)})", "snils")
holds("rule_residence_permit", "вид на жительство ", f"concat('82 №', {_SEVEN})", "id_document")
holds("rule_birth_certificate", "свидетельство о рождении ", f"concat('II-МЮ №', {_SIX})", "id_document")
holds("rule_date_words", "это было ", f"concat({_DAY}, ' ', {_MONTH}, ' ', {_YEAR}, ' года')", "date", ", спасибо")
holds("rule_date_ordinal", "это было ", f"concat({_DAY}, '-го ', {_MONTH}, ' ', {_YEAR})", "date", ", спасибо")
holds("rule_date_iso", "это было ", f"concat({_YEAR}, '-05-', lpad({_DAY}, 2, '0'))", "date", ", спасибо")
holds("rule_date_year_first", "это было ", f"concat({_YEAR}, ' г., ', {_DAY}, ' ', {_MONTH})", "date", ", спасибо")
holds("rule_date_word_short_year", "это было ", f"concat({_DAY}, '-го ', {_MONTH}, ' ', cast({KEY} % 60 + 20 as string), '-го')", "date", ", спасибо")
holds("rule_birth_year_labelled", "она ", f"concat({_YEAR}, ' года рождения')", "birth_date", ", спасибо")
holds("rule_birth_year", "она ", _YEAR, "birth_date", " г.р., спасибо")
holds("rule_date_short_year", "родился ", f"concat(lpad({_DAY}, 2, '0'), '.05.', cast({KEY} % 60 + 20 as string))", "birth_date", ", спасибо")

_UNITS = "первого второго третьего четвертого пятого шестого седьмого восьмого девятого десятого".split()
_TENS = {50: "пятьдесят", 60: "шестьдесят", 70: "семьдесят", 80: "восемьдесят"}
_ONES = "первого второго третьего четвертого пятого шестого седьмого восьмого девятого".split()
holds("detector_datewords", "это было ", f"concat({picked(tuple(_UNITS))}, ' ', {_MONTH}, ' тысяча девятьсот ', {picked(tuple(_TENS.values()), 7)}, ' ', {picked(tuple(_ONES), 11)}, ' года')", "date", ", спасибо")

# names: a value of the word lists in each shape; feminine forms where the shape needs one
_MEN = tuple(n.title() for n in GIVEN_NAMES if n in ("иван", "борис", "сергей", "андрей", "дмитрий", "михаил", "николай", "олег", "роман", "тимофей", "юрий", "яков", "кирилл", "павел", "максим"))
_FAMILIES = tuple(s.title() for s in SURNAMES if s.endswith(("ов", "ев", "ин")))
_FATHERS = ("Иванович", "Сергеевич", "Борисович", "Андреевич", "Олегович", "Юрьевич", "Павлович")
_UNKNOWN = ("Бахтиёр", "Севиль", "Джохар", "Тхань", "Мбаппе")
_given, _family, _father, _other = picked(_MEN), picked(_FAMILIES, 7), picked(_FATHERS, 3), picked(_UNKNOWN)
holds("names_surname_first", "Пришёл ", f"concat({_family}, ' ', {_given}, ' ', {_father})", "full_name", " вчера")
holds("names_surname_last", "Пришёл ", f"concat({_given}, ' ', {_father}, ' ', {_family})", "full_name", " вчера")
holds("names_initials", "Подписал ", f"concat({_family}, ' И. О.')", "full_name", " вчера")
holds("names_initials_first", "Подписал ", f"concat('И. О. ', {_family})", "full_name", " вчера")
holds("names_given_and_surname", "Пришёл ", f"concat({_given}, ' ', {_family})", "full_name", " вчера")
holds("names_given_and_patronymic", "клиент ", f"concat({_given}, ' ', {_father})", "full_name", " пришёл")
holds("names_unknown_between", "Пришёл ", f"concat({_family}, ' ', {_other}, ' ', {_father})", "full_name", " вчера")
holds("names_unknown_first", "Пришёл сюда ", f"concat({_other}, ' ', {_father}, ' ', {_family})", "full_name", " вчера")
holds("names_greeting", "Уважаемый ", f"concat({_other}, ' ', {_father})", "full_name", "!")
holds("names_surname_and_unknown", "зовут ", f"concat({_family}, ' ', {_other})", "full_name", " и всё")
holds("names_turkic", "Пришла ", f"concat({_family}, ' ', {_other}, ' Гюльнар кызы')", "full_name", " вчера")
holds("names_hyphen", "Пришла ", f"concat('Кравец-Брандт ', {_given}, ' ', {_father})", "full_name", ".")
holds("names_lower_case", "клиент: ", f"concat(lower({_family}), ' рахмет ', lower({_father}))", "full_name", "")
holds("names_latin", "my name is ", f"concat('John Smith', upper(substr('abcdefghijklmnopqrstuvwxyz', cast({KEY} % 26 + 1 as int), 1)), 'on')", "full_name", ", hello")
holds("names_latin_lower", "client: ", f"concat('john smith', substr('abcdefghijklmnopqrstuvwxyz', cast({KEY} % 26 + 1 as int), 1), 'on')", "full_name", ", hello")
holds("names_foreign", "пропуск для ", f"concat('Тхань ', {picked(('Мбаппе', 'Нкоса', 'Чжоу'))})", "full_name", ".")
holds("names_field", "Фамилия: ", _family, "full_name", ", спасибо")
holds("address_city_street", "Адрес: ", f"concat('г. ', {picked(tuple(t.title() for t in TOWNS if '-' not in t and ' ' not in t))}, ', ул. Ленина, д. ', {_DAY}, ', кв. ', {_DAY})", "address", ".")


def _refused(name: str, cases: tuple[tuple[str, str], ...]) -> None:
    """A query: how many spans of a category texts have that a predicate refuses, beside a control that is accepted."""
    text = f"case {KEY} % {len(cases)} " + " ".join(f"when {i} then {t}" for i, (t, _) in enumerate(cases)) + " end"
    category = f"case {KEY} % {len(cases)} " + " ".join(f"when {i} then '{c}'" for i, (_, c) in enumerate(cases)) + " end"

    def run(spark, sf):
        d = detect.detect(table(spark, sf, "customer").select(KEY, F.expr(text).alias("text"), F.expr(category).alias("category")))
        return d.select(KEY, F.size(F.filter("spans", lambda s: s["category"] == F.col("category"))).alias("n"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"select {KEY}, (case when {KEY} % {len(cases)} = 0 then 1 else 0 end)::int as n from customer"


_PHONE = f"concat('+7 (916) ', {part(_SEVEN, 1, 3)}, '-', {part(_SEVEN, 4, 2)}, '-', {part(_SEVEN, 6, 2)})"
_refused("predicates_refuse", (
    (f"concat('телефон ', {_PHONE})", "phone"),
    (f"concat('горячая линия банка ', {_PHONE})", "phone"),  # reject
    (f"concat('тел 8800', {_SEVEN})", "phone"),  # toll free
    (f"concat('ООО Ромашка, ИНН ', {_INN10})", "inn"),  # an organisation's
    (f"concat('номер заказа ', {_SEVEN}, '123')", "phone"),  # no keyword
    (f"concat('пароль от сейфа и pin ', {digits(4, 31)}, ' ', {_SIX})", "pin"),  # in a row of digits
    (f"concat('релиз v 05.12.', cast({KEY} % 60 + 20 as string))", "date"),  # a version
    (f"concat('карта 4111 1111 ', {digits(3, 31)}, 'x')", "card_number"),  # too short
    (f"concat('это было 45.', {_DAY}, '.', {_YEAR})", "date"),  # no such day
    (f"concat('служба поддержки банка help', {KEY}, '@bank.ru')", "email"),  # a service's
))


def confidence_near_keyword(spark, sf):
    """Confidence by the distance of the keyword, and less where only the keyword vouches for a number that fails its check."""
    bad = f"concat({part(_INN12, 1, 11)}, cast((cast(substr({_INN12}, 12, 1) as int) + 1) % 10 as string))"
    text = f"concat('инн', repeat(' ', cast({KEY} % 9 + 1 as int)), case {KEY} % 2 when 0 then {_INN12} else {bad} end, ' да')"
    d = detect.detect(table(spark, sf, "customer").select(KEY, F.expr(text).alias("text"))).select(KEY, F.explode("spans").alias("s"))
    return d.where("s.category = 'inn'").select(KEY, F.round("s.confidence", 9).alias("confidence"))


QUERIES["confidence_near_keyword"] = confidence_near_keyword
ORACLE_SQL["confidence_near_keyword"] = (
    f"select {KEY}, round(0.9::double - 0.2 * ({KEY} % 2) + 0.05 + 0.01 * (1 - ({KEY} % 9 + 1) / 60.0::double), 9) as confidence from customer"
)

# places: listed and declined states, authorities behind dates, birth places behind dates and prefixes
_STATES = ("Египта", "Лихтенштейна", "Норвегии", "Японии", "Канады", "Мексики", "Чили", "Перу", "Ирака", "Кубы", "Сербии", "Латвии", "Катара")
holds("citizenship_declined", "гражданин ", picked(_STATES), "citizenship", ", проживает")
holds("citizenship_label", "гражданство: ", picked(("РФ", "Республика Корея", "Того", "Российская Федерация", "Сан-Марино")), "citizenship", ".")
holds("citizenship_english", "He has ", picked(("Russian", "German", "Chinese", "Kazakh")), "citizenship", " citizenship")
_TOWN = picked(tuple(t.title() for t in TOWNS if "-" not in t and " " not in t))
holds("issuer_behind_date", "паспорт выдан 12.05.2010 ", f"concat('ОВД № ', {_DAY}, ' района г. ', {_TOWN})", "passport_issuer", ", дата рождения")
holds("issuer_with_number", "кем выдан: ", f"concat({_DAY}, ' отделением милиции')", "passport_issuer", ". Проживает")
holds("issuer_goes_on", "выдан ", f"concat('ГУ МВД России по г. ', {_TOWN}, ', отделение № ', {_DAY})", "passport_issuer", ", копия приложена")
holds("issuer_sixteen_words", "выдан ", f"concat('УФМС по ', repeat('слову ', 13), cast({KEY} as string))", "passport_issuer", " лишнее слово и ещё")
holds("birthplace_prefix", "место рождения: ", f"concat('г. ', {_TOWN})", "birth_place", "; далее")
holds("birthplace_behind_date", "родилась 12.05.1990 в ", _TOWN, "birth_place", "; далее")
holds("birthplace_region", "место рождения: ", f"concat('дер. Малиновка, ', {picked(('Тульская область', 'Пермский край', 'Рязанской области'))})", "birth_place", "; далее")

# addresses: a part of each kind beside what makes it an address
_STREET = picked(("Ленина", "Мира", "Гагарина", "Пушкина"))
holds("address_index_country", "Адрес: ", f"concat('11', lpad(cast({KEY} % 10000 as string), 4, '1'), ', Россия, г. ', {_TOWN}, ', ул. ', {_STREET}, ', д. ', {_DAY})", "address", "; спасибо")
holds("address_region_district", "проживает: ", f"concat('Тульская область, Ясногорский район, с. ', {_TOWN})", "address", "; спасибо")
holds("address_bare_house", "доставить: ", f"concat('пр-т ', {_STREET}, ', ', {_DAY})", "address", "; спасибо")
holds("address_bare_street", "живу в ", f"concat('г. ', {_TOWN}, ', ', {_STREET}, ' ', {_DAY}, ', кв. ', {_DAY})", "address", "; спасибо")
holds("address_street_behind", "приду на ", f"concat('Тверская улица, ', {_DAY}, ' корп. ', {_DAY})", "address", "; спасибо")
holds("address_box", "Пишите: ", f"concat('а/я ', {_DAY}, ', г. ', {_TOWN})", "address", "; спасибо")
holds("address_field", "Улица: ", _STREET, "address", ";")
_refused("address_refuses", (
    (f"concat('живу: ул. ', {_STREET}, ', д. ', {_DAY})", "address"),
    (f"concat('отделение банка на ул. ', {_STREET}, ' д. ', {_DAY})", "address"),  # an organisation's
    (f"concat('позвоните на горячую линию банка ', {_DAY})", "address"),  # a hotline
    (f"concat({_TOWN}, ' слезам не верит')", "address"),  # a town alone
    (f"concat('у нас дом ', {_DAY})", "address"),  # a house alone
))
