"""Names of people: tokens get kinds from word lists and endings, and shapes over kinds are tried in order of certainty.

A shape is a row of letters, one a token: S a surname (listed, famous or by its ending), N a given name, P a patronymic, I an
initial, M a Turkic marker, o any of these but a patronymic or initial, u a capitalised word of no kind, v one that is at
most a surname by its ending, w the same in any case. Texts without Cyrillic letters have no kinds; Latin and foreign names
need a keyword before them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import regex

from ..functions.dictionaries import FAMOUS_PEOPLE, GIVEN_NAMES, SURNAMES
from ..functions.validators import luhn
from .rules import Span, Text

# Endings, markers, stop words and keywords.
NAME_ENDINGS = "а я у ю ой ей ом ем е и ы".split()
SURNAME_ENDINGS = "ыми ими ого ому ами ах ым им ой ом ем а у ы е".split()
FAMOUS_ENDINGS = "ыми ими ого ому ами ах ым им ой ом ем а я у ы е й".split()
POSSESSIVE = ("ов", "ев", "ин", "ын")
FAMILY_ENDINGS = (
    "ский", "цкий", "ская", "цкая", "енко", "ук", "юк", "ян", "дзе", "швили", "ых", "их", "ова", "ева", "ёва", "ина", "ына", "ов", "ев", "ёв", "ин", "ын",
)
DECLINED_FAMILY_ENDINGS = ("ов", "ев", "ёв", "ин", "ын", "ский", "цкий", "ская", "цкая")
MASCULINE_PATRONYMICS, FEMININE_PATRONYMICS = ("ович", "евич", "ич"), ("овн", "евн", "ичн", "иничн")
MARKERS = frozenset(("кызы", "оглы", "улы"))
STOPS = frozenset(
    "банк москва россия российская федерация область город улица дом клиент паспорт отделение офис договор счёт карта номер карты зачисления для на по от "
    "гражданин гражданка республики республика дата место рождения рождение рожден рождён xxxx тест тестов тестовой январь января февраль февраля март "
    "апрель апреля май мая июнь июня июль июля августа сентябрь сентября октябрь октября ноябрь ноября декабрь декабря понедельник вторник среда "
    "четверг пятница суббота воскресенье основной гражданина гражданину гражданином гражданине имя фамилия фамилию отчество свидетель клиентка заёмщик "
    "заемщик созаёмщик созаемщик заявитель оператор".split()
)
ROLES = (
    "клиент", "клиентка", "заявитель", "гражданин", "гражданка", "держатель", "владелец", "фио", "имя", "зовут", "меня зовут", "сотрудник", "менеджер",
    "фамилия", "фамилию", "отчество", "свидетель", "заёмщик", "заемщик", "созаёмщик", "созаемщик", "поручитель", "получатель", "отправитель", "вкладчик",
    "представитель",
)
FIELDS = ("фамилия", "фамилию", "отчество", "свидетель")
GREETINGS = ("уважаемый", "уважаемая", "уважаемые")
ACTIONS = (
    "позвонил", "позвонила", "звонил", "звонила", "обратился", "обратилась", "пришёл", "пришла", "просил", "просила", "попросил", "попросила",
)
LOWER_CASE = ("клиент", "фио", "ф.и.о", "заёмщик", "заемщик", "имя", "зовут", "обращаться", "представьтесь", "фамилию", "фамилия")
LATIN = ("my name is", "name:", "full name:", "имя:", "клиент", "заявитель", "фио:", "ф.и.о", "client:")
FOREIGN = ("обращаться", "зовут", "фамилию", "фамилия", "фио", "представьтесь", "пропуска", "для", "на имя")
SUBJECTS = (
    "клиент", "клиентка", "заёмщик", "заемщик", "созаёмщик", "созаемщик", "заявитель", "гражданин", "гражданка", "фио", "ф.и.о", "имя", "зовут", "на имя",
    "для", "паспорт", "тел.", "тел:", "телефон", "поручитель", "получатель", "отправитель", "держатель", "вкладчик", "владелец счета", "владелец счёта",
    "представитель", "доверенное лицо", "позвонил", "позвонила", "звонил", "звонила", "обратился", "обратилась", "пришёл", "пришла",
)
RELATIVE = regex.compile(r"(?<![а-яё])мо(?:й|я|его|ю)\s+(?:брат|муж|жен|сын|доч|отц|отец|матер|мать)[а-яё]*")
OTHER_DATA = regex.compile(
    r"(?:\+7|8|7)[\s(-]*[0-9]{3,4}[\s)-]*[0-9]{2,3}[\s-]*[0-9]{2}[\s-]*[0-9]{2}|(?<![0-9A-Za-z_])(?:[0-9]{4}\s+[0-9]{6}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}"
    r"|[0-9]{3}[\s-][0-9]{3}[\s-][0-9]{3}[\s-][0-9]{2}|[0-9]{12})(?![0-9A-Za-z_])|[0-9]{4}\s+года\s+рожд|[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}",
    regex.IGNORECASE,
)
CARD_LIKE = regex.compile(r"[0-9](?:[ -]*[0-9]){12,}")

# From here on the lists in use.
NAMES = frozenset(GIVEN_NAMES)
NAME_STEMS = frozenset(n[:-1] if n.endswith(("а", "я", "й")) else n for n in GIVEN_NAMES)
SURNAME_STEMS = frozenset(next((s[: -len(p)] for p in POSSESSIVE if s.endswith(p)), s) for s in SURNAMES)
PATRONYMICS = tuple(
    [s + e for s in MASCULINE_PATRONYMICS for e in ("", "а", "у", "ы", "е", "ем", "ом", "и", "ей", "ам", "ами", "ах")]
    + [s + e for s in FEMININE_PATRONYMICS for e in ("а", "ы", "е", "у", "ой", "ою", "ам", "ами", "ах")]
)


def _without(word: str, endings) -> str:
    return next((word[: -len(e)] for e in endings if word.endswith(e)), word)


def stem(word: str) -> str:
    """What the forms of a name share: one case ending and then one possessive ending less."""
    return _without(_without(word, FAMOUS_ENDINGS), ("ов", "ев", "ёв", "ин", "ын"))


FAMOUS = tuple(Counter(map(stem, who.split())) for who in FAMOUS_PEOPLE)
FAMOUS_SURNAMES = frozenset(stem(who.split()[-1]) for who in FAMOUS_PEOPLE)


def is_given_name(low: str) -> bool:
    if low in NAMES:
        return True
    stems = [low[: -len(e)] for e in NAME_ENDINGS if low.endswith(e)]
    return any(s in NAMES or s in NAME_STEMS or s == "павл" for s in stems)


def is_listed_surname(low: str) -> bool:
    if stem(low) in FAMOUS_SURNAMES:
        return True
    bases = [low, *(low[: -len(e)] for e in (*SURNAME_ENDINGS, *POSSESSIVE) if low.endswith(e))]
    return any(b[: -len(p)] in SURNAME_STEMS for b in bases for p in POSSESSIVE if b.endswith(p))


def ends_like_surname(low: str) -> bool:
    return low.endswith(FAMILY_ENDINGS) or any(low[: -len(e)].endswith(DECLINED_FAMILY_ENDINGS) for e in SURNAME_ENDINGS if low.endswith(e))


def is_patronymic(low: str) -> bool:
    return low.endswith(PATRONYMICS)


@lru_cache(maxsize=1 << 16)
def kinds_of(low: str) -> str:
    """N, S (listed), G (by its ending), P, I and M, as far as they hold; nothing for stop words."""
    if low in STOPS:
        return ""
    if len(low) == 2 and low[1] == ".":
        return "I"
    famous = stem(low) in FAMOUS_SURNAMES
    found = (("N", is_given_name(low)), ("S", is_listed_surname(low)), ("G", not famous and ends_like_surname(low)), ("P", is_patronymic(low)), ("M", low in MARKERS))
    return "".join(k for k, holds in found if holds)


@dataclass(slots=True)
class Token:
    start: int
    end: int
    low: str
    kinds: str
    capital: bool
    used: bool = False

    @property
    def surname(self) -> bool:
        return "S" in self.kinds or "G" in self.kinds


IS = {
    "S": lambda t: t.surname,
    "N": lambda t: "N" in t.kinds,
    "P": lambda t: "P" in t.kinds,
    "I": lambda t: "I" in t.kinds,
    "M": lambda t: "M" in t.kinds,
    "o": lambda t: bool(t.kinds) and not set(t.kinds) & {"P", "I"},
    "u": lambda t: not t.kinds and t.capital and t.low not in STOPS,
    "v": lambda t: t.kinds in ("", "G") and t.capital and t.low not in STOPS,
    "w": lambda t: t.kinds in ("", "G") and t.low not in STOPS,
}
TOKEN = regex.compile(r"(?<!\p{L})\p{L}\.|\p{L}+(?:-\p{L}+)*")
BLANK = regex.compile(r"\s*")
BLANK_OR_PAREN = regex.compile(r"[\s()]*")
PHRASE_END = regex.compile(r"[ \t]*+(?!\p{L})")


class Reader:
    """The names of one text."""

    def __init__(self, t: Text):
        self.t = t
        self.tokens = [Token(m.start(), m.end(), t.low[m.start() : m.end()], kinds_of(t.low[m.start() : m.end()]), t.raw[m.start()].isupper()) for m in TOKEN.finditer(t.raw)]
        self.found: list[Span] = []

    def near(self, at: int, n: int, words: tuple[str, ...]) -> bool:
        window = self.t.before(at, n)
        return any(w in window for w in words)

    def after(self, at: int, n: int, words: tuple[str, ...]) -> bool:
        window = self.t.after(at, n)
        return any(w in window for w in words)

    def between(self, i: int, gap=BLANK) -> bool:
        """Whether only white space (or what the gap allows) is between token i and the next."""
        return i + 1 < len(self.tokens) and gap.fullmatch(self.t.raw, self.tokens[i].end, self.tokens[i + 1].start) is not None

    def fits(self, i: int, shape: str, gap=BLANK) -> list[Token]:
        """The tokens from i on, if they are of the shape and unused; else none."""
        run = self.tokens[i : i + len(shape)] if i >= 0 else []
        if len(run) < len(shape) or not all(IS[k](x) and not x.used for k, x in zip(shape, run)):
            return []
        return run if all(self.between(j, gap) for j in range(i, i + len(shape) - 1)) else []

    def famous(self, run: list[Token]) -> bool:
        """Whether it is a famous person's name, and nothing near says that a client or relative is meant."""
        if Counter(stem(x.low) for x in run if not set(x.kinds) & {"P", "I"}) not in FAMOUS:
            return False
        a, b, t = run[0].start, run[-1].end, self.t
        if self.near(a, 30, SUBJECTS) or self.after(b, 30, SUBJECTS) or RELATIVE.search(t.before(a, 30)) or RELATIVE.search(t.after(b, 30)):
            return False
        line_end = t.raw.find("\n", b)
        for side in (t.raw[t.raw.rfind("\n", 0, a) + 1 : a], t.raw[b : line_end if line_end >= 0 else len(t.raw)]):
            if OTHER_DATA.search(side) or any(luhn(m.group()) for m in CARD_LIKE.finditer(side)):
                return False
        return True

    def emit(self, run: list[Token], confidence: float, start: int | None = None, end: int | None = None) -> int:
        for x in run:
            x.used = True
        self.found.append((run[0].start if start is None else start, run[-1].end if end is None else end, "full_name", "names", confidence))
        return len(run)

    def maiden(self, i: int) -> int | None:
        """Where a surname stands whose bearer's other surname follows in parentheses: that at i."""
        if i and self.tokens[i - 1].surname and "(" in self.t.raw[self.tokens[i - 1].end : self.tokens[i].start] and self.between(i - 1, BLANK_OR_PAREN):
            if ")" in self.t.raw[self.tokens[i].end : self.tokens[i + 1].start]:
                self.tokens[i - 1].used = True
                return self.tokens[i - 1].start
        return None

    def whole_line(self, a: int, b: int) -> bool:
        raw = self.t.raw
        stop = raw.find("\n", b)
        return not raw[raw.rfind("\n", 0, a) + 1 : a].strip() and not raw[b : stop if stop >= 0 else len(raw)].strip()

    def at(self, i: int) -> int:
        """Tokens taken from i on by the first shape that fits; 0 without one."""
        x, raw = self.tokens[i], self.t.raw
        if (run := self.fits(i, "SuuM", BLANK_OR_PAREN)) and not self.famous(run):
            return self.emit(run, 0.95)
        for shape in ("SoP", "NPS", "SII", "NII", "IIS"):
            if (run := self.fits(i, shape)) and not self.famous(run):
                marked = i + 3 < len(self.tokens) and IS["M"](self.tokens[i + 3]) and self.between(i + 2)
                return self.emit([*run, self.tokens[i + 3]] if marked else run, 0.95)
        for shape in ("NS", "SN", "NP"):
            if not (run := self.fits(i, shape)) or self.famous(run):
                continue
            if shape == "NP":
                before = self.tokens[i - 1] if i else None
                if before and before.surname and self.between(i - 1) and self.famous([before, *run]):
                    continue
                if not (self.near(x.start, 30, ROLES) or self.after(run[1].end, 30, ACTIONS) or PHRASE_END.match(raw, run[1].end)):
                    continue
            left = self.tokens[i - 1] if i else None
            if left and not left.kinds and left.capital and not left.used and "-" in left.low and left.low not in STOPS and self.between(i - 1):
                left.used = True
                return self.emit(run, 0.85, start=left.start)
            return self.emit(run, 0.85)
        for shape, confidence in (("SvP", 0.95), ("SwP", 0.9)):
            if not (run := self.fits(i, shape, BLANK_OR_PAREN)) or self.famous(run):
                continue
            if shape == "SwP" and not (self.near(run[1].start, 40, LOWER_CASE) or self.whole_line(x.start, run[2].end)):
                continue
            return self.emit(run, confidence, start=self.maiden(i))
        if (run := self.fits(i - 1, "uPS")) and not self.famous(run):
            return self.emit(run, 0.9) - 1
        if (run := self.fits(i - 1, "uP")) and self.near(run[0].start, 20, GREETINGS) and not self.famous(run):
            return self.emit(run, 0.85) - 1
        if (run := self.fits(i, "Su")) and "\n" not in raw[x.end : run[1].start] and self.near(x.start, 30, ROLES) and not self.famous(run):
            return self.emit(run, 0.9)
        if "N" in x.kinds:
            return self.emit([x], 0.8) if self.near(x.start, 30, ROLES) else 0
        if (x.surname or "P" in x.kinds) and self.near(x.start, 25, FIELDS):
            beside = [j for j, on in ((i - 1, i > 0 and self.between(i - 1)), (i + 1, self.between(i))) if on]
            if not any(self.tokens[j].kinds and not self.tokens[j].used for j in beside):
                return self.emit([x], 0.75)
        return 0

    def latin(self) -> None:
        """Two or three capitalised Latin words behind a keyword, or two to four in lower case right behind one."""
        plain = [x.low.isascii() and x.low.isalpha() for x in self.tokens]
        i = 0
        while i < len(self.tokens):
            n = 1
            if plain[i] and not self.tokens[i].used:
                capital = self.tokens[i].capital
                fit = lambda j: plain[j] and not self.tokens[j].used and self.tokens[j].capital == capital and (capital or len(self.tokens[j].low) > 1)  # noqa: E731, B023
                while n < (3 if capital else 4) and self.between(i + n - 1) and fit(i + n):
                    n += 1
                run = self.tokens[i : i + n]
                if n > 1 and fit(i) and (self.near(run[0].start, 40, LATIN) if capital else any(self.t.before(run[0].start, len(w) + 2).rstrip(" \t").endswith(w) for w in LATIN)):
                    self.emit(run, 0.9 if capital else 0.85)
                else:
                    n = 1
            i += n

    def foreign(self) -> None:
        """Two to four capitalised words of no kind, on one line, behind a keyword and at a phrase's end."""
        fit = lambda x: not x.used and IS["u"](x) and len(x.low) > 1
        i = 0
        while i < len(self.tokens):
            n = 1
            if fit(self.tokens[i]):
                while self.between(i + n - 1) and fit(self.tokens[i + n]) and "\n" not in self.t.raw[self.tokens[i + n - 1].end : self.tokens[i + n].start]:
                    n += 1
                run = self.tokens[i : i + n]
                if 2 <= n <= 4 and self.near(run[0].start, 40, FOREIGN) and PHRASE_END.match(self.t.raw, run[-1].end):
                    self.emit(run, 0.9)
                else:
                    n = 1
            i += n

    def read(self) -> list[Span]:
        i = 0
        while i < len(self.tokens):
            x = self.tokens[i]
            i += (self.at(i) if x.kinds and not x.used else 0) or 1
        self.latin()
        if any(w in self.t.low for w in FOREIGN):
            self.foreign()
        return self.found


def names(t: Text) -> list[Span]:
    if not t.cyrillic and not any(w in t.low for w in LATIN):
        return []
    return Reader(t).read()
