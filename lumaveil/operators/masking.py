"""Masking strategies and their application: spans -> masked text and replacements; and restoring.

full and the partial modes are native expressions of a value, with twins for one text. Putting masks into a text and
restoring run in Arrow functions: one value has one mask in a document, tokens are numbered as values first occur, and a
restored fragment takes the first free place, all of which depends on order.
"""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import CATEGORIES, FULL_KEEPS, PARTIAL, SERVICE_WORDS
from ..functions.validators import INN_10, INN_12, digits

#: The names of the strategies that are always there; `strategy` adds others.
STRATEGIES = ("full", "partial", "token", "synthetic")
DIGIT_KEEP = (2, 2)
REPLACEMENT = T.StructType([T.StructField("c", T.StringType()), T.StructField("o", T.StringType()), T.StructField("m", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])

_PIECE = r"[\p{L}\p{Nd}№]+(?:-[\p{L}\p{Nd}]+)*\.?|[^\p{L}\p{Nd}№]+"


def _stars(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{L}\p{Nd}]", "*")


def mask_full(value: Column) -> Column:
    """Letters and digits become *, service words stay unless there is nothing else."""
    keep = sorted(SERVICE_WORDS | FULL_KEEPS)
    pieces = F.regexp_extract_all(value, F.lit(f"({_PIECE})"), F.lit(1))
    word = lambda p: F.lower(F.regexp_replace(p, r"\.$", ""))
    service = lambda p: word(p).isin(*keep)
    is_word = lambda p: p.rlike(r"^[\p{L}\p{Nd}№]")
    only = ~F.exists(pieces, lambda p: is_word(p) & ~service(p))
    kept = F.array_join(F.transform(pieces, lambda p: F.when(is_word(p) & ~service(p), _stars(p)).otherwise(p)), "")
    return F.when(only, _stars(value)).otherwise(kept)


def mask_digits(value: Column, head: int, tail: int) -> Column:
    """Digits but the first `head` and last `tail` become *; all do if at most one would be hidden."""
    chars = F.split(value, "")
    is_digit = lambda c: c.rlike("^[0-9]$")
    n = F.size(F.filter(chars, is_digit))
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    hide_all = n <= head + tail + 1

    def step(acc: Column, c: Column) -> Column:
        k = acc["k"] + 1
        star = hide_all | ((k > head) & (k <= n - tail))
        return F.when(is_digit(c), F.struct(k.alias("k"), F.concat(acc["out"], F.when(star, F.lit("*")).otherwise(c)).alias("out"))).otherwise(F.struct(acc["k"].alias("k"), F.concat(acc["out"], c).alias("out")))

    return F.aggregate(chars, start, step, lambda a: a["out"])


def mask_initials(value: Column) -> Column:
    """First letters with dots; hyphenated parts each; initials stay."""
    words = F.filter(F.split(value, r"[\s  ]+"), lambda w: w != "")
    part = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")), " ")


def mask_date(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"(?<=\p{L})\p{L}", "*"), r"\p{Nd}", "*")


def mask_email(value: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.when(~F.contains(value, F.lit("@")), _stars(value)).otherwise(
        F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.char_length(local) - 1), F.substring(value, F.char_length(local) + 1, F.char_length(value)))
    )


def mask_words(value: Column) -> Column:
    """Digits become *; service words and single letters stay; of other words the first letter."""
    keep = sorted(SERVICE_WORDS)
    pieces = F.regexp_extract_all(value, F.lit(f"({_PIECE})"), F.lit(1))
    word = lambda p: F.regexp_replace(p, r"\.$", "")
    hidden = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?<=\p{L})\p{L}", "*"), r"\p{Nd}", "*")
    return F.array_join(F.transform(pieces, lambda p: F.when(F.lower(word(p)).isin(*keep) | word(p).rlike(r"^\p{L}$"), p).otherwise(hidden(p))), "")


def mask_partial(value: Column, category: Column) -> Column:
    out = mask_digits(value, *DIGIT_KEEP)
    for name, (mode, head, tail) in PARTIAL.items():
        by = {"digits": lambda: mask_digits(value, head, tail), "initials": lambda: mask_initials(value), "date": lambda: mask_date(value), "email": lambda: mask_email(value), "words": lambda: mask_words(value)}[mode]()
        out = F.when(category == name, by).otherwise(out)
    return out


def _rng(category: str, value: str) -> random.Random:
    return random.Random(hashlib.sha256(f"{category}\0{value}".encode()).digest())


_MALE = ("Алексеев Алексей Алексеевич", "Борисов Борис Борисович", "Сергеев Сергей Сергеевич", "Николаев Николай Николаевич", "Павлов Павел Павлович")
_FEMALE = ("Алексеева Анна Алексеевна", "Борисова Вера Борисовна", "Сергеева Ольга Сергеевна", "Николаева Нина Николаевна", "Павлова Елена Павловна")


def _spread(value: str, new: str) -> str:
    """New digits in the places of the old ones."""
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in value)


def _check_luhn(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def _check_inn(rng: random.Random, n: int) -> str:
    d = [rng.randrange(1, 10) for _ in range(10 if n == 12 else 9)]
    for w in INN_12 if n == 12 else (INN_10,):
        d.append(sum(a * b for a, b in zip(w, d)) % 11 % 10)
    return "".join(map(str, d))


def _check_snils(rng: random.Random) -> str:
    d = [rng.randrange(1, 10) for _ in range(9)]
    total = sum(x * (9 - i) for i, x in enumerate(d))
    check = total % 101 if total > 101 else total
    return "".join(map(str, d)) + f"{0 if check >= 100 else check:02d}"


_LATIN_NAMES = ("Alex", "Brooke", "Casey", "Drew", "Ellis", "Frances", "Harper", "Jordan", "Morgan", "Robin", "Taylor", "Quinn")
_MONTHS_OF = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
_WORD_DATE = regex.compile(r"([0-9]{1,2})(\S*)(\s+)(\p{L}+)(\.?\s+)([0-9]{4})(.*)", regex.DOTALL)


def _some(rng: random.Random, n: int, first: int = 0) -> str:
    return "".join(str(rng.randrange(first, 10)) for _ in range(n))


def _fake_name(value: str, rng: random.Random) -> str:
    """A name of as many words, with initials, capitals and the alphabet of the old one."""
    words = value.split()
    known = (_FEMALE if words[-1].lower().rstrip(".").endswith(("а", "я")) else _MALE)[rng.randrange(5)].split()
    out = []
    for i, w in enumerate(words):
        latin = w.isascii()
        new = _LATIN_NAMES[rng.randrange(len(_LATIN_NAMES))] if latin else known[min(i, 2)]
        if regex.fullmatch(r"\p{L}\.", w):
            new = new[0] + "."
        elif len(w) > 1 and w.isupper():
            new = new.upper()
        out.append(new.lower() if w.islower() else new)
    return " ".join(out)


def _fake_date(value: str, rng: random.Random) -> str | None:
    day, month, year = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1950, 2006)
    if m := regex.fullmatch(r"([0-9]{1,4})([./-])([0-9]{1,2})\2([0-9]{1,4})", value):
        if len(m[1]) == 4:
            return f"{year}{m[2]}{month:02d}{m[2]}{day:02d}"
        return f"{day:02d}{m[2]}{month:02d}{m[2]}{year if len(m[4]) == 4 else year % 100:0{len(m[4])}d}"
    if m := _WORD_DATE.fullmatch(value):
        return f"{day}{m[2]}{m[3]}{_MONTHS_OF[month - 1]}{m[5].lstrip('.')}{year}{m[7]}"
    return None


def fake(value: str, category: str) -> str | None:
    """A valid value of the same layout, the same for the same input; None where there is none (a token takes its place)."""
    rng, d = _rng(category, value), digits(value)
    n = len(d)
    for _ in range(20):
        out = None
        if category in ("full_name", "card_holder"):
            out = _fake_name(value, rng)
        elif category == "email":
            out = f"user{hashlib.sha256(value.encode()).hexdigest()[:6]}@example.com"
        elif category == "card_number" and 13 <= n <= 19:
            out = _spread(value, _check_luhn("4" + _some(rng, n - 2)))
        elif category == "inn" and n in (10, 12):
            out = _spread(value, _check_inn(rng, n))
        elif category == "snils" and n == 11:
            out = _spread(value, _check_snils(rng))
        elif category == "phone" and n == 11:
            out = _spread(value, d[0] + "9" + _some(rng, 9))
        elif category == "phone" and n >= 10:
            out = _spread(value, d[: n - 7] + _some(rng, 7, 1))
        elif category == "passport" and n == 10 and regex.fullmatch(r"[0-9 №  ]+", value):
            out = _spread(value, _some(rng, 10, 1))
        elif category in ("foreign_passport", "driver_license", "division_code", "id_document", "cvv", "pin") and n:
            out = _spread(value, _some(rng, n, 1))
        elif category in ("date", "birth_date", "passport_date"):
            out = _fake_date(value, rng)
        if out is None or out != value:
            return out
    return None


PIECE = regex.compile(_PIECE)
WORD = regex.compile(r"^[\p{L}\p{Nd}№]")


def stars(value: str) -> str:
    return regex.sub(r"[\p{L}\p{Nd}]", "*", value)


def full_of(value: str) -> str:
    """mask_full of one value."""
    pieces = PIECE.findall(value)
    hide = [bool(WORD.match(p)) and p.removesuffix(".").lower() not in SERVICE_WORDS | FULL_KEEPS for p in pieces]
    return "".join(stars(p) if h else p for p, h in zip(pieces, hide)) if any(hide) else stars(value)


def partial_of(value: str, category: str, rules: dict = PARTIAL) -> str:
    """mask_partial of one value."""
    mode, head, tail = rules.get(category, ("digits", *DIGIT_KEEP))
    if mode == "initials":
        return " ".join("-".join(p[:1].upper() + "." for p in w.split("-")) for w in value.split())
    if mode == "date":
        return regex.sub(r"\p{Nd}", "*", regex.sub(r"(?<=\p{L})\p{L}", "*", value))
    if mode == "email" and "@" in value:
        local, at, domain = value.partition("@")
        return local[:1] + "*" * (len(local) - 1) + at + domain
    if mode == "email":
        return stars(value)
    if mode == "words":
        hidden = lambda p: regex.sub(r"\p{Nd}", "*", regex.sub(r"(?<=\p{L})\p{L}", "*", p))
        stays = lambda w: w.lower() in SERVICE_WORDS or bool(regex.fullmatch(r"\p{L}", w))
        return "".join(p if stays(p.removesuffix(".")) else hidden(p) for p in PIECE.findall(value))
    n = len(digits(value))
    out, k = [], 0
    for c in value:
        if c in "0123456789":
            k += 1
            c = "*" if n <= head + tail + 1 or head < k <= n - tail else c
        out.append(c)
    return "".join(out)


def token_of(value: str, category: str, number: int) -> str:
    return f"[{category.upper()}_{number}]"


#: By name: (value, category, the value's number among those of its category) -> mask.
MASKS: dict[str, Callable[[str, str, int], str]] = {
    "full": lambda value, category, number: full_of(value),
    "partial": lambda value, category, number: partial_of(value, category),
    "token": token_of,
    "synthetic": lambda value, category, number: fake(value, category) or token_of(value, category, number),
}


def strategy(name: str, mask: Callable[[str, str, int], str]) -> None:
    """Add a strategy, or put another in its place. Functions for executors ship their own copy of the registry."""
    MASKS[name] = mask


def partial_rules(config: dict, own: dict | None = None) -> dict[str, tuple[str, int, int]]:
    """(mode, digits kept at the head, at the tail) by category, from a configuration with `defaults` and `categories`."""
    modes = {"digits", "initials", "date", "email", "words"}
    defaults = config.get("defaults", {})
    out = dict(PARTIAL if own is None else own)
    for category, rule in config.get("categories", {}).items():
        if category not in CATEGORIES:
            raise ValueError(f"unknown category {category!r}")
        mode = rule.get("mode", defaults.get("mode", "digits"))
        head, tail = (rule.get(k, defaults.get(k, n)) for k, n in zip(("keep_head", "keep_tail"), DIGIT_KEEP))
        if mode not in modes or min(head, tail) < 0:
            raise ValueError(f"{category}: mode {mode!r}, {head} and {tail} digits kept")
        out[category] = (mode, head, tail)
    return out


def put_masks(text: str, spans: list, strategy: str) -> tuple[str, list[dict]]:
    """The masked text and its replacements. A value keeps the mask that it got first, whatever category it has later;
    token numbers count a category's values as they first occur. Spans that overlap an earlier one or lie outside are left."""
    known: dict[str, str] = {}
    seen: dict[str, int] = {}
    out, replacements, at, size = [], [], 0, 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        a, b, category = s["start"], s["end"], s["category"]
        if a < at or b <= a or b > len(text):
            continue
        value = text[a:b]
        if value not in known:
            seen[category] = seen.get(category, 0) + 1
            known[value] = MASKS.get(strategy, MASKS["partial"])(value, category, seen[category])
        mask = known[value]
        out += [text[at:a], mask]
        size += a - at + len(mask)
        replacements.append({"c": category, "o": value, "m": mask, "s": size - len(mask), "e": size})
        at = b
    return "".join([*out, text[at:]]), replacements


APPLIED = T.StructType([T.StructField("masked", T.StringType()), T.StructField("replacements", T.ArrayType(REPLACEMENT))])


@F.pandas_udf(APPLIED)
def put_masks_udf(texts: pd.Series, spans: pd.Series, strategies: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None or s is None else put_masks(t, list(s), k) for t, s, k in zip(texts, spans, strategies)]
    return pd.DataFrame(rows, columns=["masked", "replacements"])


def allowed(spans: list, categories, combos) -> list:
    """policy.keep_categories of one text's spans."""
    present = {s["category"] for s in spans}
    wanted = set(categories) if categories is not None else set()
    needs: dict[str, set] = {}
    for r in combos if combos is not None else ():
        needs.setdefault(r["category"], set(r["requires_any"]))
    return [s for s in spans if (not wanted or s["category"] in wanted) and (s["category"] not in needs or needs[s["category"]] & present)]


ALLOWED = T.StructType([*APPLIED.fields, T.StructField("found", T.IntegerType())])


@F.pandas_udf(ALLOWED)
def put_allowed_masks_udf(texts: pd.Series, spans: pd.Series, strategies: pd.Series, categories: pd.Series, combos: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s, k, c, r in zip(texts, spans, strategies, categories, combos):
        kept = None if t is None or s is None else allowed(list(s), c, r)
        rows.append((None, None, None) if kept is None else (*put_masks(t, kept, k), len(kept)))
    return pd.DataFrame(rows, columns=["masked", "replacements", "found"]).astype({"found": "Int32"})


put_allowed_masks_udf = put_allowed_masks_udf.asNondeterministic()
put_masks_udf = put_masks_udf.asNondeterministic()  # evaluated once, where it stands


def apply(df: DataFrame, strategy: str | Column, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with masked and replacements: array<struct<c,o,m,s,e>>, offsets in the masked text in code points."""
    kind = F.lit(strategy) if isinstance(strategy, str) else F.coalesce(strategy, F.lit("partial"))
    done = df.withColumn("_d", put_masks_udf(F.col(text), F.col(spans), kind))
    return done.withColumn("masked", F.col("_d.masked")).withColumn("replacements", F.col("_d.replacements")).drop("_d")


def restore(masked: str, replacements: list) -> tuple[str, int]:
    """The originals put back, and how many found no place: first where they were recorded, then where their mask occurs.

    Places taken are kept in order; the search for a mask goes on where its last one ended.
    """
    starts: list[int] = []
    claims: list[tuple[int, int, str]] = []
    late = []
    for r in sorted(replacements, key=lambda r: (r["s"], r["e"])):
        a, b, m = r["s"], r["e"], r["m"]
        if m and 0 <= a < b <= len(masked) and masked[a:b] == m and (not claims or a >= claims[-1][1]):
            claims.append((a, b, r["o"]))
            starts.append(a)
        else:
            late.append(r)
    misses = 0
    reached: dict[str, int] = {}
    for r in late:
        m = r["m"]
        at = masked.find(m, reached.get(m, 0)) if m else -1
        while at >= 0:
            i = bisect_right(starts, at)
            if (i == 0 or claims[i - 1][1] <= at) and (i == len(starts) or at + len(m) <= starts[i]):
                break
            at = masked.find(m, at + 1)
        reached[m] = at + 1 if at >= 0 else len(masked) + 1
        if at < 0:
            misses += 1
            continue
        starts.insert(i, at)
        claims.insert(i, (at, at + len(m), r["o"]))
    out, at = [], 0
    for a, b, original in claims:
        out += [masked[at:a], original]
        at = b
    return "".join([*out, masked[at:]]), misses


RESTORED = T.StructType([T.StructField("restored", T.StringType()), T.StructField("misses", T.IntegerType())])


@F.pandas_udf(RESTORED)
def restore_udf(masked: pd.Series, replacements: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([restore(m, list(r)) if m is not None and r is not None else (None, None) for m, r in zip(masked, replacements)], columns=["restored", "misses"]).astype({"misses": "Int32"})


restore_udf = restore_udf.asNondeterministic()
