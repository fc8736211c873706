"""Citizenship, birth places and passport issuers: a keyword, what may stand between, and where the value ends."""

from __future__ import annotations

import regex

from ..functions.dictionaries import COMMON_WORD_STATES, COUNTRY_FORMS, OTHER_STATES, TOWNS
from . import people
from .rules import Span, Text

_MONTHS = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря|янв|фев|мар|апр|май|июн|июл|авг|сен|сент|окт|ноя|дек"
_DAY = rf"[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}|[0-9]{{1,2}}\s+(?:{_MONTHS})\.?\s+[0-9]{{4}}"


def _any(words) -> str:
    return "|".join(regex.escape(w) for w in sorted(set(words), key=len, reverse=True))


# --- citizenship


def declined(name: str) -> list[str]:
    """The forms of a place's name, by its last letters; names in -о, -и, -у, -е and the like have one."""
    if name == "египет":
        return [name, *("египт" + e for e in ("а", "у", "ом", "е"))]
    if name.endswith("ия"):
        return [name, *(name[:-1] + e for e in ("и", "ю", "ей"))]
    if name.endswith("а"):
        return [name, *(name[:-1] + e for e in ("и" if name[-2] in "гкхжшщч" else "ы", "е", "у", "ой"))]
    if name.endswith("я"):
        return [name, *(name[:-1] + e for e in ("и", "е", "ю", "ей"))]
    if name.endswith("й"):
        return [name, *(name[:-1] + e for e in ("я", "ю", "ем", "е"))]
    if name.endswith("ь"):
        return [name, *(name[:-1] + e for e in ("и", "ью", "я", "ю", "ем", "е"))]
    if name.endswith("ы"):
        return [name, name[:-1], *(name[:-1] + e for e in ("ам", "ами", "ах"))]
    if name[-1] in "бвгджзклмнпрстфхцчшщ" and len(name) > 3:
        return [name, *(name + e for e in ("а", "у", "ом", "е"))]
    return [name]


#: English names of states beside their adjectives.
IN_ENGLISH = ("russian federation", "russia", "belarus", "kazakhstan", "usa")
STATES = frozenset(COUNTRY_FORMS) | frozenset(IN_ENGLISH) | {f for s in OTHER_STATES for f in declined(s)}
STATE = regex.compile(rf"(?:{_any(STATES)})(?!\p{{L}})|республик[аиуойе]?\s+[а-яё]+")
CITIZEN = regex.compile(r"(?<!\p{L})(?:гражданство|гражданин|гражданка|citizenship)(?!\p{L})\s*([:—-])?\s*(?:(?:заявителя|клиента)\s*:?\s*)?")
STATE_BEFORE = regex.compile(rf"(?<!\p{{L}})({_any(STATES)})\s*(?=citizenship(?!\p{{L}}))")
ASKED = regex.compile(r"^[^\n]*гражданств[^\n]*\?[^\n]*\n(?:[^\n:]*:)?[ \t]*", regex.MULTILINE)
ANY_VALUE = regex.compile(r"(?!(?:не|нет|неизвестно|отсутствует|н/д)(?![a-zа-яё-]))[a-zа-яё-]+(?:\s+[a-zа-яё-]+){0,2}")


def citizenships(t: Text) -> list[Span]:
    found: dict[tuple[int, int], None] = {}
    if "гражда" not in t.low and "citizen" not in t.low:
        return []
    for m in CITIZEN.finditer(t.low):
        own = STATE.match(t.low, m.end())
        if own and not m.group(1) and own.group() in COMMON_WORD_STATES and not t.raw[own.start()].isupper():
            own = None
        if own is None and m.group(1):
            own = ANY_VALUE.match(t.low, m.end())
        if own:
            found[own.span()] = None
    for m in STATE_BEFORE.finditer(t.low):
        found[m.span(1)] = None
    for m in ASKED.finditer(t.low):
        if own := STATE.match(t.low, m.end()):
            found[own.span()] = None
    return [(a, b, "citizenship", "citizenship", 0.9) for a, b in found]


# --- passport issuers

ISSUED = regex.compile(
    r"(?<!\p{L})(?:кем выдан|выдавший орган|орган выдачи|орган, выдавший|дата выдачи|выдано|выдана|выдан|выдали|выдачи|получал|получала|получил|получила|получен|получена|кем|орган)(?!\p{L})"
)
BETWEEN = regex.compile(
    rf"(?:\s*(?:{_DAY}|[0-9]{{1,4}}-х(?:\s+(?:годах|года|гг\.?))?)(?:\s+(?:года|г\.|г(?!\p{{L}})))?|(?:клиент|оператор)\s*:\s*|(?:в|г\.?|гор\.?|мне|был|была|паспорт)(?!\p{{L}})|[^а-яё]+)*+"
)
AUTHORITY = regex.compile(
    r"паспортным столом|межрайонным|отделени(?:ем|и|я)|отдел(?:ом|е)?|управлени(?:ем|я|е)|миграционн(?:ым|ой)|паспортно-визовым|паспортн(?:ым|ого)"
    r"|(?:генеральн(?:ым|ое) )?консульств(?:ом|о|а)|посольств(?:ом|о|а)|министерств(?:ом|о) внутренних дел|гу мвд|гувм мвд|гувд|оуфмс|уфмс|фмс|омвд|умвд|увм|овм|увд|овд|мвд|милиции|о/м|тп|оп|мп"
)
OF_STATE = regex.compile(r"(?<!\p{L})(?:внутренних дел|уфмс|мвд|овд|увд|омвд|умвд|милиции|полиции|россии|района|р-на|города|г\.|по|№)(?!\p{L})")
ISSUER_END = regex.compile(rf"\n|;|{_DAY}|код подразделения|к/п|дата выдачи|выдан|гражданство")
SHORTENED = frozenset("г ул д кв пр пер обл респ стр корп оф пом комн пос дер ст город наб пл ш р-н пгт т др пр-т пр-д б-р".split())
GOES_ON = frozenset("по в и г город район района области отдел отделом отделение отделением тп № край края округ округа".split())
MOST_WORDS, REACH = 16, 300


def issuer_end(t: Text, start: int) -> int:
    """Before the first date or keyword, the end of a sentence, a comma after which no part of the name comes, or 16 words."""
    end = min(len(t.low), start + REACH)
    if m := ISSUER_END.search(t.low, start, end):
        end = m.start()
    for m in regex.finditer(r"(\S*)\.", t.low[start:end]):
        at = start + m.end() - 1
        upper = t.raw[at + 1 : at + 2] == " " and t.raw[at + 2 : at + 3].isupper()
        if m.group(1) not in SHORTENED and (at + 1 == len(t.low) or upper):
            end = at
            break
    for m in regex.finditer(r",\s*([^\s,]*)", t.low[start:end] + " "):
        follows = regex.match(r"\s*([^\s,]*)", t.low, pos=start + m.start() + 1).group(1)
        if follows and follows not in GOES_ON:
            end = start + m.start()
            break
    words = list(regex.finditer(r"\S+", t.low[start:end]))
    if len(words) > MOST_WORDS:
        end = start + words[MOST_WORDS - 1].end()
    return start + len(t.low[start:end].rstrip(" ,."))


def issuers(t: Text) -> list[Span]:
    found: dict[tuple[int, int], None] = {}
    for m in ISSUED.finditer(t.low):
        stop = min(len(t.low), m.end() + REACH)
        start = BETWEEN.match(t.low, m.end(), stop).end()
        own = AUTHORITY.match(t.low, start, stop)
        if not own or own.group().startswith("отдел") and not OF_STATE.search(t.low, start, min(stop, start + 40)):
            continue
        # a number of the department right before it, if it is no year
        number = regex.search(r"(?<![./0-9-])[0-9]+ $", t.low[max(m.end(), start - 12) : start])
        if number and not regex.search(rf"(?:{_MONTHS})\.?\s+[0-9]+ $", t.low[m.end() : start]):
            start -= len(number.group())
        end = issuer_end(t, start)
        if end > start:
            found[start, end] = None
    return [(a, b, "passport_issuer", "issuer", 0.9) for a, b in found]


# --- birth places

SETTLEMENTS = (
    "посёлоке", "поселке", "посёлка", "посёлок", "поселок", "деревня", "деревне", "станица", "станице", "городе", "город", "гор.", "г.", "пос.", "с.", "ст.", "дер.", "д.",
    "пгт", "аул", "х.", "хутор", "п.", "рп", "село", "селе", "кишлаке", "кишлак",
)
IN_PLACE = ("городе ", "деревне ", "посёлке ", "поселке ", "селе ", "станице ", "кишлаке ")
REGIONS = r"область|области|обл\.|край|края|района|район|республики|республика|асср"
BARE_REGIONS = "татарстан татарстана башкортостан башкортостана дагестан дагестана чечня чечни коми мордовия мордовии якутия якутии бурятия бурятии крым крыма".split()
BORN = regex.compile(
    r"место рождения|место рожд\.|город рождения|родился\s+в\s+|родилась\s+в\s+|родился|родилась|рожд[её]н в|уроженец|уроженка|(?<!\p{L})(?:род\.|ур\.)|(?<![0-9a-z_])born(?![0-9a-z_])"
)
_YEAR = r"(?:г\.|года|году|г)?\s*"
BORN_WHEN = regex.compile(rf"\s*:?\s*(?:—\s*)?(?:(?:{_DAY}|[0-9]{{4}})\s+{_YEAR}в\s+)?(?:я\s+)?(?:(?:в|in)\s+)?")
PLACE = regex.compile(
    rf"(?:(?:{_any(SETTLEMENTS)})\s*)?(?:{_any(TOWNS)}|[а-яё-]+|[a-z-]+)(?:\s+(?!(?:{REGIONS})(?!\p{{L}}))[а-яё-]+)??"
    rf"(?:,?\s*(?:(?:республики|республика)\s+[а-яё-]+|[а-яё-]+\s+(?:{REGIONS})|(?:{REGIONS})|(?:{_any(BARE_REGIONS)}))(?!\p{{L}})){{0,2}}(?!\p{{L}})"
)
NO_PLACE = frozenset("как где когда что который которая которое которые".split())


def birth_places(t: Text) -> list[Span]:
    out = []
    for m in BORN.finditer(t.low):
        when = BORN_WHEN.match(t.low, m.end())
        own = PLACE.match(t.low, when.end())
        if not own or m.group().startswith("родил") and famous_before(t, m.start()):
            continue
        start, value = own.start(), own.group()
        value = value[: value.find("граждан")] if "граждан" in value else value
        value = value.rstrip(" ,")
        prefix = next((p for p in sorted(SETTLEMENTS, key=len, reverse=True) if value.startswith(p) and value[len(p) : len(p) + 1] in ("", " ", ".") or p.endswith(".") and value.startswith(p)), "")
        body = value[len(prefix) :].strip()
        at = start + len(prefix) + len(value[len(prefix) :]) - len(value[len(prefix) :].lstrip())
        named = bool(body) and (t.raw[at].isupper() or body.startswith(TOWNS))
        if not body or not named and (not prefix or body.split()[0] in NO_PLACE):
            continue
        if left := next((p for p in IN_PLACE if value.startswith(p)), ""):
            start, value = start + len(left), value[len(left) :]
        if len(value.split()) <= 10:
            out.append((start, start + len(value), "birth_place", "birthplace", 0.92))
    return out


def famous_before(t: Text, at: int) -> bool:
    """Whether the last two or three words before are a famous person's name that no client bears."""
    base = max(0, at - 40)
    reader = people.Reader(Text(t.raw[base:at].rstrip()))
    for n in (3, 2):
        run = reader.tokens[-n:]
        if len(run) == n and reader.famous(run):
            return not any(w in t.before(at, 60) for w in people.SUBJECTS)
    return False
