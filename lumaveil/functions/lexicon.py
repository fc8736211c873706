"""Categories, rule patterns with their keywords, and word lists. Patterns are in RE2's dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

CATEGORIES = (
    "full_name birth_date birth_place passport citizenship passport_issuer division_code passport_date driver_license address "
    "email phone inn card_number cvv pin card_holder snils foreign_passport id_document date"
).split()


@dataclass(frozen=True)
class Rule:
    """A pattern with the predicates that accept its matches. least: digits that each match holds; reclassify: categories
    with the keywords to the left and right that give them."""

    name: str
    category: str
    pattern: str
    confidence: float = 0.9
    validator: str = ""
    soft: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    required: bool = False
    left: int = 40
    right: int = 20
    reject: tuple[str, ...] = ()
    reject_within: int = 25
    deny: tuple[str, ...] = ()
    deny_within: int = 25
    lower: bool = False
    group: int = 0
    alone_in_digits: bool = False
    date_gap: bool = False
    dates: bool = False
    least: int = 0
    reclassify: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()
    tags: tuple[str, ...] = field(default=())


# Fixed values from here on.
_S = r"[\s\x{00A0}\x{202F}]"
_D = r"[\s\x{00A0}\x{202F}-]"
_HOTLINE = ("горячая линия", "горячей линии", "бесплатно по россии", "служба поддержки", "поддержки банка")
_NUMBER = ("номер", "номеру", "номера", "тел", "телефон", "телефону", "позвон", "позвоните", "позвонить")
_MOBILE = ("телефон", "тел", "моб", "мобильный", "номер телефона", "сотовый", "whatsapp", "telegram")
_LEGAL = ("ооо", "ао", "пао", "кпп", "огрн", "организац")
_CVV = (
    "cvv", "cvc", "cvv2", "cvc2", "код безопасности", "код с обратной стороны карты", "код с обратной стороны", "код на обороте",
    "на обороте", "три цифры на обороте",
)
_PIN = ("pin", "пин", "пин-код", "pin-код", "код от карты")
_LOCKS = ("wi-fi", "wifi", "домофон", "подъезд", "сейф", "замок", "пароль", "сигнализац")
_DIVISION = ("код подразделения", "к/п", "код подр")
_DRIVER = ("водительское", "в/у", "ву", "права", "удостоверение")
_SNILS = ("снилс", "страховой номер")
_ABROAD = (
    "загранпаспорт", "загран", "заграничный паспорт", "заграничный", "загран.", "иностранный паспорт",
    "паспорт иностранного гражданина", "паспорт кнр",
)
_MILITARY = ("военный билет", "военник", "воен. билет", "военного билета", "билет офицера запаса", "удостоверение военнослужащего")
_RESIDENCE = ("вид на жительство", "внж", "вида на жительство", "разрешение на временное проживание", "рвп")
_BIRTH_PAPER = ("свидетельство о рождении", "свид. о рождении", "свидетельства о рождении", "св-во о рождении")
_MONTHS = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
_SHORT_MONTHS = "янв|фев|мар|апр|мая|май|июн|июл|авг|сен|сент|окт|ноя|дек"
_ENGLISH_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_ORDINAL = "(?:-го|-е|-ого|-его)"
_PAIR = rf"\d{{2}}{_S}\d{{2}}"

RULES = (
    Rule("phone_ru", "phone", rf"(?i)(?:\+7|8|7)[\s\x{{00A0}}\x{{202F}}(-]*\d{{3,4}}[\s\x{{00A0}}\x{{202F}})-]*\d{{2,3}}{_D}*\d{{2}}{_D}*\d{{2}}",
         validator="phone", context=("телефон", "тел"), reject=_HOTLINE, reject_within=150, least=10),
    Rule("phone_moscow", "phone", rf"(?i)\(\d{{3}}\){_D}*\d{{3}}{_D}*\d{{2}}{_D}*\d{{2}}", validator="phone10", required=True,
         context=_NUMBER, after=_NUMBER, deny=("+7", "8"), deny_within=3, least=10),
    Rule("phone_e164", "phone", rf"(?i)\+\d{{1,3}}{_D}*\d{{2,3}}{_D}*\d{{3,4}}{_D}*\d{{2,4}}{_D}*\d{{2,4}}", 0.95, validator="phone_e164",
         reject=_HOTLINE, reject_within=150, least=10),
    Rule("phone_ru_mobile", "phone", rf"(?i)\b9\d{{2}}{_D}?\d{{3}}{_D}?\d{{2}}{_D}?\d{{2}}\b", validator="phone10", required=True, left=30,
         context=_MOBILE, after=_MOBILE, least=10),
    Rule("email", "email", r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.\p{L}{2,}", 0.95, validator="not_service_email",
         reject=("работает круглосуточно", "служба поддержки", "горячая линия", "поддержки банка")),
    Rule("inn", "inn", r"(?i)\b\d{12}\b", validator="inn", soft=("инн",), context=("инн",), least=12),
    Rule("inn_legal", "inn", r"(?i)\b\d{10}\b", validator="inn", required=True, context=("инн", "юрлицо", "ип"), reject=_LEGAL, least=10),
    Rule("inn_spaced", "inn", rf"(?i)\b(?:\d{{4}}{_D}\d{{4}}{_D}\d{{4}}|\d{{4}}{_D}\d{{3}}{_D}\d{{3}}|\d{{3}}{_D}\d{{3}}{_D}\d{{4}}|\d{{2}}{_D}\d{{4}}{_D}\d{{4}})\b",
         validator="inn", soft=("инн",), required=True, context=("инн",), reject=_LEGAL, reject_within=40, least=10),
    Rule("card_number", "card_number", r"(?i)(?:\d[ \x{00A0}\x{202F}-]?){13,19}", validator="luhn", soft=("карта", "карты", "номер карты", "card", "pan"),
         context=("карта", "card", "номер карты"), least=13),
    Rule("cvv", "cvv", r"(?i)\b\d{3,4}\b", required=True, left=60, alone_in_digits=True, context=_CVV, after=_CVV, deny=_LOCKS, least=3),
    Rule("pin", "pin", r"(?i)\b\d{4}\b", required=True, left=50, alone_in_digits=True, context=_PIN, after=_PIN, deny=_LOCKS, least=4),
    Rule("passport", "passport",
         rf"(?:серия{_S}*:?{_S}*(\d{{4}})[\s\x{{00A0}}\x{{202F}},.]*номер{_S}*:?{_S}*(\d{{6}})"
         rf"|паспорт{_S}*:?{_S}*(?:с\.{_S}*)?(\d{{4}}){_S}*(?:№|номер|н\.|ном\.)?{_S}*(\d{{6}})"
         rf"|\b(\d{{4}}){_S}+(\d{{6}})\b|\b(\d{{4}}){_S}*(?:№|номер|н\.|ном\.){_S}*(\d{{6}})\b|\b({_PAIR}){_S}(\d{{6}})\b"
         rf"|серия{_S}*:?{_S}*({_PAIR}){_S}*[,.]?{_S}*(?:№|номер{_S}*:?){_S}*(\d{{6}})|\b({_PAIR}){_S}*[,.]?{_S}*(?:№|номер{_S}*:?){_S}*(\d{{6}})\b)",
         validator="passport", lower=True, least=10),
    Rule("passport_bare", "passport", r"(?i)\b\d{10}\b", validator="passport", soft=("паспорт", "серия"), required=True,
         context=("паспорт", "серия", "серия и номер", "паспортные данные"), least=10),
    Rule("division_code", "division_code", rf"(?i)\b\d{{3}}{_S}*[-\x{{2010}}-\x{{2015}}]{_S}*\d{{3}}\b", required=True, left=60,
         context=(*_DIVISION, "код"), after=(*_DIVISION, "код"), reject=("ошибок", "ошибка"), reject_within=30, least=6),
    Rule("division_code_spaced", "division_code", rf"(?i)\b\d{{3}}{_S}+\d{{3}}\b", required=True, left=30, context=_DIVISION, after=_DIVISION, least=6),
    Rule("division_code_bare", "division_code", r"(?i)\b\d{6}\b", required=True, left=20, context=_DIVISION, least=6),
    Rule("driver_license", "driver_license",
         rf"(?i)(?:\b\d{{2}}{_S}\d{{2}}{_S}\d{{6}}\b|\b\d{{4}}{_S}\d{{6}}\b|\b\d{{2}}{_S}?[a-zа-яё]{{2}}{_S}?\d{{6}}\b|\b\d{{10}}\b)",
         required=True, context=_DRIVER, after=_DRIVER, least=8),
    Rule("driver_license_labeled", "driver_license", rf"(?i)\b{_PAIR}{_S}*(?:№|номер){_S}*\d{{6}}\b", 0.92, required=True, date_gap=True, context=_DRIVER, after=_DRIVER, least=10),
    Rule("snils", "snils", r"(?i)(?:\b\d{3}[\s-]\d{3}[\s-]\d{3}[\s-]\d{2}\b|\b\d{11}\b)", validator="snils", soft=_SNILS, required=True, context=_SNILS, after=_SNILS, least=11),
    Rule("foreign_passport", "foreign_passport", r"(?i)(?:\b\d{2}\s\d{7}\b|\b[A-Z]{1,2}\d{7,8}\b|\b\d{9}\b)", required=True, context=_ABROAD, after=_ABROAD, least=7),
    Rule("military_id", "id_document", r"(?i)(?:^|[^А-ЯЁ])([А-ЯЁ]{2}\s?(?:№|номер)?\s?\d{7})\b", group=1, required=True, context=_MILITARY, after=_MILITARY, least=7),
    Rule("residence_permit", "id_document", r"(?i)\b\d{2}\s?№?\s?\d{7}\b", required=True, context=_RESIDENCE, after=_RESIDENCE, least=9),
    Rule("birth_certificate", "id_document", r"(?i)\b[IVX]{1,4}-[А-ЯЁ]{2}\s?№?\s?\d{6}\b", required=True, context=_BIRTH_PAPER, after=_BIRTH_PAPER, least=6),
    Rule("date", "date",
         rf"(?:\b\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}\b|\b\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}\b|\b\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\b(?:\s+(?:года|г\.|г))?"
         rf"|\b\d{{1,2}}{_ORDINAL}\s+(?:{_MONTHS})\s+\d{{4}}\b|\b\d{{1,2}}\s+(?:{_SHORT_MONTHS})\.?\s+\d{{4}}\b"
         rf"|\b\d{{4}}\s+г\.?\s*,?\s+\d{{1,2}}{_ORDINAL}?\s+(?:{_MONTHS})|\b\d{{1,2}}\s+(?:{_ENGLISH_MONTHS})\s+\d{{4}}\b)",
         0.85, validator="date", lower=True, dates=True, least=5),
    Rule("date_word_short_year", "date", rf"(?i)\b\d{{1,2}}{_ORDINAL}\s+(?:{_MONTHS})\s+\d{{2}}-го(?:[^\p{{L}}]|$)", 0.85, validator="date_word_short_year", lower=True, dates=True, least=3),
    Rule("birth_year_labeled", "birth_date", r"(?i)\b(?:19|20)\d{2}\s+года\s+рождения(?:[^\p{L}]|$)", 0.6, least=4),
    Rule("birth_year", "birth_date", r"(?i)\b(?:19|20)\d{2}\b", 0.6, required=True, left=10, right=10, context=("г.р.", "г. р."), after=("г.р.", "г. р."), least=4),
    Rule("date_short_year", "date", r"(?:\b\d{1,2}[./-]\d{1,2}[./-]\d{2}\b)", 0.85, validator="date_short_year", lower=True, dates=True,
         reject=("верси", "релиз", "build", "v"), reject_within=40, least=4),
)

SERVICE_MAILBOXES = frozenset("support info noreply no-reply help sales office hello press pr hr feedback mail clients client".split())
OWN_DOMAINS = frozenset({"alfabank.ru"})
MONTHS = {m: i % 12 + 1 for i, m in enumerate(f"{_MONTHS}|{_ENGLISH_MONTHS}".split("|"))} | {
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "сент": 9, "окт": 10, "ноя": 11, "дек": 12,
}

BIRTH_WORDS = (
    "родился", "родилась", "родились", "родил", "рожден", "рождён", "дата рождения", "дату рождения", "уроженец", "уроженка", "г.р.", "г. р.",
    "д.р.", "др", "род.", "род", "рожд.", "рожд", "birth", "dob", "born",
)
BIRTH_WORDS_AFTER = ("года рождения", "рождения", "р.", "место рождения", *BIRTH_WORDS)
ISSUE_WORDS = (
    "выдан", "выдано", "выдали", "выдал", "выдала", "дата выдачи", "дату выдачи", "получал", "получала", "получил", "получила", "получен",
    "поменял", "поменяла", "doc_issue", "issue",
)
OTHER_PAPERS = (
    "в/у", "водительск", "вид на жительство", "внж", "доверенность", "справка", "действительн", "билет", "полис", "сертификат", "лицензия",
)
OTHER_PAPERS_WHOLE = ("ву",)
DIVISION_WORDS = _DIVISION

SERVICE_WORDS = frozenset(
    "ул улица д дом кв г гор город обл область корп стр пр-т пер пл наб ш р-н район край серия номер № года год г.р.".split()
)
FULL_KEEPS = frozenset("по в и".split())
PARTIAL = {
    "cvv": ("digits", 0, 0), "pin": ("digits", 0, 0), "division_code": ("digits", 0, 0), "full_name": ("initials", 0, 0), "card_holder": ("initials", 0, 0),
    "birth_date": ("date", 0, 0), "passport_date": ("date", 0, 0), "date": ("date", 0, 0), "email": ("email", 0, 0),
    "address": ("words", 0, 0), "passport_issuer": ("words", 0, 0), "citizenship": ("words", 0, 0), "birth_place": ("words", 0, 0),
}
