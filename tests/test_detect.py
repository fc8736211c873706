import pytest
from pyspark.sql import functions as F

from lumaveil.functions import validators as V
from lumaveil.functions.lexicon import CATEGORIES, RULES
from lumaveil.operators import detect as D
from lumaveil.operators import rules
from lumaveil.operators.rules import Text


def found(text, category=None):
    return [text[a:b] for a, b, c, _, _ in D.raw_spans(text, D.default()) if category in (None, c)]


def resolved(spark, texts):
    df = D.detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    return [[(t[s.start : s.end], s.category) for s in r.spans] for r, t in zip(df.orderBy("i").collect(), texts)]


def test_validators():
    assert V.luhn("4111 1111 1111 1111") and not V.luhn("4111 1111 1111 1112")
    assert V.inn("500100732259") and not V.inn("500100732258") and V.inn("7707083893")
    assert V.snils("112-233-445 95") and not V.snils("112-233-445 96")
    assert V.passport("4509 123456") and not V.passport("0000 123456") and not V.passport("4509 000000")
    assert V.phone("+7 (916) 123-45-67") and not V.phone("8 800 200-00-00") and V.phone10("9161234567")
    assert V.date("29.02.2000") and not V.date("29.02.1900") and V.date("12 мая 1990 года") and V.date("1985 г., 5 марта") and not V.date("31.02.1990")
    assert V.date_short_year("05.03.85") and not V.date_short_year("45.13.85") and V.date_word_short_year("25-го марта 90-го")
    assert not V.not_service_email("info@alfabank.ru") and V.not_service_email("i.ivanov@alfabank.ru")


def test_rule_table():
    assert len(RULES) == 28 and {r.category for r in RULES} <= set(CATEGORIES)
    for r in RULES:
        assert r.validator in ("", *V.VALIDATORS)
        rules.compiled(r.pattern)


@pytest.mark.parametrize(
    "text, category, want",
    [
        ("Перезвоните по номеру +7 (916) 123-45-67", "phone", ["+7 (916) 123-45-67"]),
        ("Мой номер 89161234567", "phone", ["89161234567"]),
        ("Номер заказа 9161234567", "phone", []),
        ("Позвоните на +1 916 123 45 67", "phone", ["+1 916 123 45 67"]),
        ("карта 4111 1111 1111 1111 пин 4321", "pin", ["4321"]),
        ("пин-код от домофона 4321", "pin", []),
        ("СНИЛС 112-233-445 95", "snils", ["112-233-445 95"]),
        ("код подразделения 770-001", "division_code", ["770-001"]),
        ("Загранпаспорт 71 1234567", "foreign_passport", ["71 1234567"]),
        ("военный билет АБ 1234567", "id_document", ["АБ 1234567"]),
        ("вид на жительство 82 №1234567", "id_document", ["82 №1234567"]),
        ("свидетельство о рождении II-МЮ №123456", "id_document", ["II-МЮ №123456"]),
        ("письмо info@alfabank.ru", "email", []),
        ("письмо ivan.petrov@mail.ru.", "email", ["ivan.petrov@mail.ru"]),
        ("версия 05.03.85", "date", []),
        ("держатель карты IVAN PETROV", "card_holder", ["IVAN PETROV"]),
        ("гражданство РФ", "citizenship", ["РФ"]),
        ("место рождения: г. Казань", "birth_place", ["г. Казань"]),
        ("Адрес: ул. Ленина, д. 5, кв. 12", "address", ["ул. Ленина, д. 5, кв. 12"]),
        ("паспорт выдан ОУФМС России по городу, код", "passport_issuer", ["ОУФМС России по городу"]),
        ("Клиент Иванов Иван Иванович пришёл", "full_name", ["Иванов Иван Иванович"]),
    ],
)
def test_detectors(text, category, want):
    assert found(text, category) == want


def test_composite(spark):
    text = (
        "Иван Петров, дата рождения 12.05.1990, гражданство РФ. Паспорт 4509 123456 выдан 05.12.1990, код подразделения 770-001. Водительское "
        "удостоверение 77 12 345678, СНИЛС 112-233-445 95. Загранпаспорт 71 1234567. Email ivan.petrov@example.com, телефон +7 (916) 123-45-67. "
        "ИНН 500100732259, карта 4111 1111 1111 1111, CVV 123, ПИН-код 1234."
    )
    want = {
        ("Иван Петров", "full_name"), ("12.05.1990", "birth_date"), ("РФ", "citizenship"), ("4509 123456", "passport"), ("05.12.1990", "passport_date"), ("770-001", "division_code"),
        ("77 12 345678", "driver_license"), ("112-233-445 95", "snils"), ("71 1234567", "foreign_passport"), ("ivan.petrov@example.com", "email"),
        ("+7 (916) 123-45-67", "phone"), ("500100732259", "inn"), ("4111 1111 1111 1111", "card_number"), ("123", "cvv"), ("1234", "pin"),
    }
    assert want - set(resolved(spark, [text])[0]) == set()


def test_dates_are_told_apart(spark):
    texts = [
        "род. 12 окт 1969", '{"birth": "1995-02-17"}', '{"doc_issue": "15-03-2015"}', "issue date 04.28.2011", "DOB was 12.31.1975", "ВУ 77 12 345678. Выдано 14.06.2018",
        "Родился я двенадцатого мая тысяча девятьсот девяностого года, а паспорт мне выдали двадцать первого августа две тысячи девятнадцатого года.",
    ]
    kinds = [[c for _, c in r if "date" in c] for r in resolved(spark, texts)]
    assert kinds == [["birth_date"], ["birth_date"], ["passport_date"], ["passport_date"], ["birth_date"], ["date"], ["birth_date", "passport_date"]]


def test_resolve(spark):
    def run(spans):
        rows = [(a, b, "x", "regex", c) for a, b, c in spans]
        df = spark.createDataFrame([(rows,)], "spans array<struct<start:int,end:int,category:string,detector:string,confidence:double>>")
        return [(s.start, s.end) for s in df.select(D.resolve(F.col("spans")).alias("r")).first().r]

    assert run([(0, 10, 0.9), (5, 12, 0.8), (9, 20, 0.95)]) == [(9, 20)]
    assert run([(0, 5, 0.9), (0, 5, 0.9), (0, 9, 0.9)]) == [(0, 9)]
    assert run([(3, 9, 0.9), (9, 12, 0.5), (0, 4, 0.8)]) == [(3, 9), (9, 12)]
    assert run([]) == []


def test_parts_equal_the_whole(spark):
    unit = "Клиент Иванов Иван Иванович, тел +7 (916) 123-45-67, карта 4111 1111 1111 1111. Обычный текст без данных. "
    text = unit * 900
    assert len(D.parts(text)) > 1
    assert {(a, b, c) for a, b, c, _, _ in D.raw_spans(text, D.default())} == {(a, b, c) for a, b, c, _, _ in D.default()(text)}


def test_registry_prunes():
    r = D.default().enabled(["email"])
    assert [d[0] for d in r.detectors] == ["regex"]
    with pytest.raises(ValueError):
        D.Registry().add("x", {"nope"}, lambda t: [])


def test_text_keeps_positions():
    t = Text("İstanbul ТЕЛ")
    assert len(t.low) == len(t.raw) and t.low.endswith("тел")


def test_nulls_and_sql(spark):
    D.register(spark)
    rows = spark.sql("select detect_pii('mail a@b.ru') as s").first().s
    assert [(r.start, r.end, r.category) for r in rows] == [(5, 11, "email")]
    assert spark.sql("select category from detect_pii_rows('mail a@b.ru')").first().category == "email"
    df = spark.createDataFrame([(None,), ("",), ("plain words",)], "text string")
    assert [r.spans for r in D.detect(df).collect()] == [None, [], []]


def test_prefilter_keeps_whatever_a_detector_finds(spark):
    texts = [
        "Citizenship: Russia", "Citizenship: USA, thanks", "citizenship: usa", "CITIZENSHIP: RUSSIA", "name: Ivan Petrov", "my name is ivan petrov", "Client: Anna Maria Petrova", "Anna\tA.\tB.",
        "name on card Ivan  Petrov", "cardholder: Ivan Petrov", "call me", "mail a@b.ru", "plain words", "",
    ]
    rows = D.detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    want = [D.spans_of(t, D.default()) for t in texts]
    assert [[tuple(s) for s in r.spans] for r in rows] == [[tuple(s) for s in w] for w in want]
    assert all(want[:3]) and all(want[4:7])


def test_whole_dictionaries():
    from lumaveil.functions import dictionaries as W

    assert [len(x) for x in (W.GIVEN_NAMES, W.SURNAMES, W.TOWNS, W.FAMOUS_PEOPLE)] == [len(set(x)) for x in (W.GIVEN_NAMES, W.SURNAMES, W.TOWNS, W.FAMOUS_PEOPLE)]
    missed = [n for n in W.GIVEN_NAMES if not found(f"Клиент {n.title()} пришёл", "full_name")]
    missed += [n for n in W.SURNAMES if not found(f"Вчера Анна {n.title()} пришла", "full_name")]
    missed += [n for n in W.TOWNS if found(f"Адрес: {n.title()}, ул. Ленина, д. 5", "address") != [f"{n.title()}, ул. Ленина, д. 5"]]
    missed += [n for n in W.FAMOUS_PEOPLE if not n.endswith("ович") and not n.endswith("евич") and found(f"стихи {n.title()} читали", "full_name")]
    assert missed == []


def test_places_by_keyword_gap_and_end():
    from lumaveil.operators import places as P
    from lumaveil.operators.rules import Text

    values = lambda find, x: [x[a:b] for a, b, *_ in find(Text(x))]
    for text, want in (
        ("гражданство того человека", []), ("гражданство: Того", ["Того"]), ("гражданство: не указано", []), ("гражданин Египта", ["Египта"]),
        ("Гражданка Республики Беларусь", ["Республики Беларусь"]), ("гражданство?\nРоссия", ["Россия"]), ("He has Russian citizenship", ["Russian"]),
    ):
        assert values(P.citizenships, text) == want, text
    for text, want in (
        ("выдан отделом продаж", []), ("кем выдан: 2 отделением милиции. Проживает", ["2 отделением милиции"]),
        ("выдан ГУ МВД России по г. Москве, отделение № 5, копия", ["ГУ МВД России по г. Москве, отделение № 5"]),
        ("паспорт выдан 12.05.2010 ОВД района Хамовники г. Москвы, дата", ["ОВД района Хамовники г. Москвы"]),
    ):
        assert values(P.issuers, text) == want, text
    for text, want in (
        ("родился в городе Казани", ["Казани"]), ("клиент родился где-то там", []), ("Лев Толстой родился в Ясной Поляне", []), ("родился", []),
        ("место рождения: с. Ивановка, Рязанской области, РФ", ["с. Ивановка, Рязанской области"]),
    ):
        assert values(P.birth_places, text) == want, text


def test_addresses_by_parts_and_groups():
    from lumaveil.operators import addresses as A
    from lumaveil.operators.rules import Text

    for text, want in (
        ("живу в Казани, Ленина 15, кв. 3", ["Казани, Ленина 15, кв. 3"]), ("Отделение банка: ул. Ленина, д. 5", []), ("Москва слезам не верит", []),
        ("офис на ул. Ленина, д. 5, проживаю ул. Мира, д. 6", ["ул. Мира, д. 6"]), ("ул. Ленина, д. 5. Телефон банка", ["ул. Ленина, д. 5"]), ("дом 5", []),
        ("г. Санкт-Петербург, Невский проспект, д. 1", ["г. Санкт-Петербург, Невский проспект, д. 1"]), ("Город: Москва\nУлица: Мира, Дом: 5", ["Москва", "Мира", "5"]),
        ("115093, Россия, Москва, Тверская улица, 7 корп. 2", ["115093, Россия, Москва, Тверская улица, 7 корп. 2"]), ("позвоните на горячую линию банка", []),
    ):
        assert [text[a:b] for a, b, *_ in A.addresses(Text(text))] == want, text


def test_names_in_every_shape():
    from lumaveil.operators.people import names
    from lumaveil.operators.rules import Text

    for text, want in (
        ("Мамедова Севиль Фарид кызы", ["Мамедова Севиль Фарид кызы"]), ("Иванова (Петрова) Севиль Эльдаровна", ["Иванова (Петрова) Севиль Эльдаровна"]),
        ("Уважаемая Севиль Эльдаровна!", ["Севиль Эльдаровна"]), ("Александр Сергеевич позвонил вчера", ["Александр Сергеевич"]), ("Александр Сергеевич гулял", []),
        ("Лев Толстой писал", []), ("клиент Лев Толстой", ["Лев Толстой"]), ("мой брат Лев Толстой", ["Лев Толстой"]), ("Лев Толстой, тел +7 916 123-45-67", ["Лев Толстой"]),
        ("Гагарина Юрия Алексеевича знают", []), ("ахметзянова зульфия ильгизовна", ["ахметзянова зульфия ильгизовна"]), ("name: John Smith Brown", ["John Smith Brown"]),
        ("на имя Джон Смит.", ["Джон Смит"]), ("на имя Джон Смит пришло", []), ("3. Отчество: Дмитриевна", ["Дмитриевна"]),
    ):
        assert [text[a:b] for a, b, *_ in names(Text(text))] == want, text
