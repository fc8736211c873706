import random

import pytest
from pyspark.sql import functions as F

from lumaveil.operators import detect as D
from lumaveil.operators import masking as M
from lumaveil.functions import validators as V


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_full(spark):
    pairs = {
        "Иванов Иван Иванович": "****** **** ********", "4509 123456": "**** ******", "+7 (916) 123-45-67": "+* (***) ***-**-**", "ivan@mail.ru": "****@****.**",
        "12 мая 1990 года": "** *** **** года", "г. Казани": "г. ******", "ул. Ленина, д. 5, кв. 12": "ул. ******, д. *, кв. **",
        "ОУФМС России по г. Москве": "***** ****** по г. ******", "серия 4509 номер 123456": "серия **** номер ******", "РФ": "**", "Российская Федерация": "********** *********",
    }
    assert column(spark, M.mask_full, pairs) == list(pairs.values())


def test_partial(spark):
    two = lambda c: M.mask_digits(c, 2, 2)
    pairs = {
        "4509 123456": "45** ****56", "4111 1111 1111 1111": "41** **** **** **11", "+7 (916) 123-45-67": "+7 (9**) ***-**-67", "500100732259": "50********59",
        "112-233-445 95": "11*-***-*** 95", "77 12 345678": "77 ** ****78", "71 1234567": "71 *****67",
    }
    assert column(spark, two, pairs) == list(pairs.values())
    assert column(spark, lambda c: M.mask_digits(c, 0, 0), ["770-001", "123", "1234"]) == ["***-***", "***", "****"]
    assert column(spark, M.mask_initials, ["Иванов Иван Иванович", "IVAN IVANOV", "Салтыков-Щедрин", "Иванов И. О."]) == ["И. И. И.", "I. I.", "С.-Щ.", "И. И. О."]
    assert column(spark, M.mask_date, ["12.05.1990", "12 мая 1990", "12 мая 1990 года"]) == ["**.**.****", "** м** ****", "** м** **** г***"]
    assert column(spark, M.mask_email, ["ivan.petrov@mail.ru"]) == ["i**********@mail.ru"]
    assert column(spark, M.mask_words, ["ул. Ленина, д. 5, кв. 12", "ГУ МВД России по г. Москве"]) == ["ул. Л*****, д. *, кв. **", "Г* М** Р***** п* г. М*****"]


def test_twins_agree(spark):
    values = ["г. Казани", "РФ", "И. О.", "ул. Ленина, д. 5", "4509 123456", "ivan@mail.ru", "12 мая 1990 года", "Салтыков-Щедрин", "a1б2", "no digits", "1", "№ 5", "по в и"]
    assert column(spark, M.mask_full, values) == [M.full_of(v) for v in values]
    for category in ("phone", "cvv", "full_name", "date", "email", "address"):
        assert column(spark, lambda c: M.mask_partial(c, F.lit(category)), values) == [M.partial_of(v, category) for v in values]


def r(o, m, s, e):
    return {"c": "x", "o": o, "m": m, "s": s, "e": e}


def test_restore():
    assert M.restore("[PHONE_1] is your number, thanks.", [r("A", "[PHONE_1]", 0, 9)] * 2) == ("A is your number, thanks.", 1)
    assert M.restore("Call [PHONE_1] or [PHONE_1] again.", [r("A", "[PHONE_1]", 0, 9)] * 2) == ("Call A or A again.", 0)
    assert M.restore("Call [PHONE_1] please.", [r("A", "[PHONE_1]", 0, 9), r("B", "[EMAIL_1]", 20, 29)]) == ("Call A please.", 1)
    assert M.restore("[PHONE_1] belongs to [NAME_1].", [r("N", "[NAME_1]", 0, 8), r("P", "[PHONE_1]", 20, 29)]) == ("P belongs to N.", 0)
    bad = [r("x", "a", -5, -1), r("x", "b", 100, 200), r("x", "c", 3, 1), r("x", "d", 0, 1000), r("x", "", 0, 0)]
    assert M.restore("zzz", bad) == ("zzz", 5)
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("ab*[] ") for _ in range(20))
        M.restore(text, [r("O", text[a : a + rng.randint(0, 4)], rng.randint(-3, 25), rng.randint(-3, 25)) for a in range(6)])


@pytest.mark.parametrize("strategy", M.STRATEGIES)
def test_round_trip(spark, strategy):
    texts = [
        "Клиент Иванов Иван Иванович, паспорт 4509 123456, тел +7 (916) 123-45-67",
        "ivan@mail.ru и ещё раз ivan@mail.ru, ИНН 500100732259; СНИЛС 112-233-445 95", "😀 карта 4111 1111 1111 1111, дата рождения 12.05.1990", "", "пусто",
    ]
    df = M.apply(D.detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")), strategy)
    for row in df.withColumn("b", M.restore_udf("masked", "replacements")).collect():
        assert (row.b.restored, row.b.misses) == (row.text, 0)
        for x in row.replacements:
            assert row.masked[x.s : x.e] == x.m and x.o != x.m
        assert len({(x.o, x.m) for x in row.replacements}) == len({x.o for x in row.replacements})
    first = df.where("i = 1").first()
    if strategy == "token":
        assert first.masked.startswith("[EMAIL_1] и ещё раз [EMAIL_1], ИНН [INN_1]; СНИЛС [SNILS_1]")


def test_fakes_are_valid_and_others():
    for i in range(200):
        card = f"4111 1111 1111 {i:04d}"
        new = M.fake(card, "card_number")
        assert V.luhn(new) and new != card and new.count(" ") == 3 and M.fake(card, "card_number") == new
        assert V.inn(M.fake(f"{500100732000 + i}", "inn")) and V.snils(M.fake(f"112-233-4{i % 90 + 10} 95", "snils"))
    assert V.luhn(M.fake("4111 1111 1111 1", "card_number")) and M.fake("4111 1111 1111", "card_number") is None
    assert V.date(M.fake("12.05.1990", "birth_date"))
